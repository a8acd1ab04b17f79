from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from ironquill.llm import toxicity
from ironquill.llm.queries import MIX_WEIGHTS, QUERIES, vocabulary_path
from tests.llm.test_mixing import count
from tests.llm.test_simhash import joined, plain

FOLDER = "/root/testdata/sf0.001"


def brute(rows, scores):
    """rows: id -> (text, source); the tokens stage's rows, from the scores of the toxicity operator on."""
    rows = {d: r for d, r in rows.items() if scores[d] < toxicity.THRESHOLD}
    last = {}
    for d, (text, _) in rows.items():
        last[text or ""] = max(d, last.get(text or "", d))
    rows = {d: rows[d] for d in last.values()}
    prints = {d: plain(t) for d, (t, _) in rows.items()}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    rows = {d: rows[d] for d in set(joined(prints, links).values())}
    sizes = Counter(s if s in MIX_WEIGHTS else None for _, s in rows.values())
    out, library = Counter(), Tokenizer.from_file(vocabulary_path())
    for d, (text, source) in rows.items():
        key = source if source in MIX_WEIGHTS else None
        weight = MIX_WEIGHTS[key] if key else 1 - sum(MIX_WEIGHTS.values())
        ids = library.encode(text or "", add_special_tokens=False).ids
        n = count("mix-1", d, weight * len(rows) / sizes[key])
        if n:
            out[d, source, len(ids), tuple(ids), library.decode(ids, skip_special_tokens=False)] += n
    return out


def test_run_matches_brute_force(spark):
    docs = {r["doc_id"]: (r["text"], r["source"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    scores = {r["doc_id"]: r["score"] for r in QUERIES["op3_toxicity"](spark, FOLDER).collect()}
    got = Counter((r["doc_id"], r["source"], r["n_tokens"], tuple(r["ids"]), r["decoded"]) for r in P.run(spark, FOLDER).collect())
    assert got == brute(docs, scores)


@pytest.mark.parametrize("name, stage", P.STAGES, ids=[n for n, _ in P.STAGES])
def test_stages_take_odd_and_no_rows(spark, name, stage):
    rows = [(1, None, None, None, None, "x"), (None, "only this one has no id, and some words", "en", "src0", 3, "x"), (2, "", "en", "", 0, "x"),
            (3, "same text in two rows of the table", "en", "src1", 5, "x"), (3, "same text in two rows of the table", "en", "src1", 5, "x"),
            (4, "long words and more of them " * 3000, "en", "hot", 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string")
    out = stage(spark, docs, FOLDER)
    if name != P.STAGES[-1][0]:
        assert out.columns == P.COLUMNS
    assert out.count() > 0 and stage(spark, docs.limit(0), FOLDER).count() == 0
