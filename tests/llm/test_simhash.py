import random

import pytest
import xxhash

from ironquill.llm import simhash as S
from ironquill.llm.components import components


def plain(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(25)]
    rows = list(base)
    for t in base[:12]:
        for _ in range(4):
            ws = t.split()
            ws[rng.randrange(len(ws))] = rng.choice(words)
            rows.append(" ".join(ws))
    return rows + ["", None, " \t\n", "ONE two", "one TWO", "é É x", "a b c d", "a b c d e"] + base[:5]


@pytest.mark.parametrize("max_bits", [2, 4, 7])
def test_groups_match_brute_force(spark, max_bits):
    rows = list(enumerate(texts()))
    prints = {d: plain(t) for d, t in rows}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= max_bits]
    want = joined(prints, links)
    got = {r["doc_id"]: r for r in S.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), max_bits=max_bits).collect()}
    for d in prints:
        assert got[d]["fingerprint"] == f"{prints[d]:016x}" and got[d]["component_id"] == want[d]


@pytest.mark.parametrize("max_bits", [2, 3, 4, 5])
def test_each_near_pair_comes_once(spark, max_bits):
    rng = random.Random(max_bits)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    values = set(centres)
    for c in centres:
        for _ in range(30):
            x = c
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
            values.add(x)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    pairs = [tuple(r) for r in S.near_pairs(spark.createDataFrame([(v,) for v in signed], "_fp long"), max_bits).collect()]
    mask = (1 << 64) - 1
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= max_bits}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_components_of_chains_stars_and_cycles(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 200 + i) for i in range(50)]
    cycle = [(300 + i, 300 + (i * 7 + 1) % 30) for i in range(30)] + [(5, 5)]
    links = chain + star + cycle
    want = joined({x for e in links if e[0] != e[1] for x in e}, links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = [(5, "same words here and more", 1), (3, "SAME words here and more", 2), (3, "quite another text of words", 3), (None, "quite another text of words", 4),
            (None, "nobody else says this at all", 5), (None, "nor does anybody say this one", 6), (9, None, 7), (8, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _fp int")
    kept = S.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r["_fp"] for r in kept.collect()) == [2, 3, 5, 6, 8]
    assert S.drop_near_copies(docs.limit(0)).count() == 0 and S.near_groups(docs.limit(0)).count() == 0
