import re

from pyspark.sql import functions as F

from ironquill.operators import secrets
from ironquill.operators.paste import analyze_text, entropy_secrets
from ironquill.rules.secret_rules import SECRET_RULES
from ironquill.sources.files import corpus_rejects, scan_files, src_file_corpus, src_lines, write_tree

AKEY = "AK" + "IA" + "Q" * 16
GH = "gh" + "p_" + "a1" * 18
HEADER = "-----BEGIN " + "OPENSSH PRIVATE KEY-----"


def files_df(spark, rows):
    return spark.createDataFrame([(r, p, False, len(c), c) for r, p, c in rows],
                                 "repo string, path string, is_link boolean, size bigint, content string")


def brute(rows):
    """All findings of each file, told line by line."""
    out = []
    for repo, path, content in rows:
        text = content.replace("\r\n", "\n").replace("\r", "\n")
        seen = set()
        for n, line in enumerate(text.splitlines(keepends=True) if "\n" in text and not re.search(
                "[\x0b\x0c\x1c-\x1e\x85  ]", text) else re.findall(r"[^\n]*\n|[^\n]+", text), 1):
            if len(line) > 2000:
                continue
            for r in SECRET_RULES:
                for m in re.finditer(r.regex, line):
                    if (r.label, m.group(0)) not in seen:
                        seen.add((r.label, m.group(0)))
                        out.append((repo, path, r.label, n))
    return sorted(out)


ROWS = [
    ("a", "one.py", f"x = 1\nkey = {AKEY}\r\nagain {AKEY} and {AKEY}\rtoken = '{GH}'"),
    ("a", "two.py", f"{AKEY}\n{HEADER}\n"),
    ("a", "pad.py", AKEY + " " * (2000 - len(AKEY)) + "\n" + GH),
    ("a", "pad2.py", AKEY + " " * (2000 - len(AKEY))),
    ("a", "sep.py", f"no break {AKEY}\n\n{GH}\n"),
    ("b", "ph.py", 'JWT_SECRET="changeme-now-please"\npassword = "12345"\npassword = "123456"\n'),
    ("b", "odd.py", 'paſsword = "abcdefgh"\napı_key = "' + "z" * 20 + '"\n'),
    ("b", "empty.py", ""),
]


def found(df):
    return sorted((r.repo, r.path, r.type, r.line) for r in df.collect())


def test_matches_brute_force(spark):
    got = found(secrets.secret_findings(files_df(spark, ROWS)))
    assert got == brute(ROWS)
    assert ("a", "pad.py", "AWS Access Key ID", 1) not in got  # 2000 characters and a line end
    assert ("a", "pad2.py", "AWS Access Key ID", 1) in got  # 2000 without
    labels = {t for r, p, t, _ in got if p == "two.py"}
    assert {"Private Key (PEM Block)", "SSH Private Key"} <= labels
    assert any(p == "odd.py" and t == "Hardcoded Password" for _, p, t, _ in got)


def test_hints_change_nothing_and_partitions_do_not_matter(spark):
    bare = tuple(r._replace(hints=()) for r in SECRET_RULES)
    df = files_df(spark, ROWS)
    assert found(secrets.secret_findings(df, bare)) == found(secrets.secret_findings(df.repartition(7)))


def test_dedup_is_idempotent(spark):
    lines = src_lines(files_df(spark, ROWS).select("repo", "path", "content"))
    once = secrets.dedup_matches(secrets.secret_match(lines))
    assert sorted(map(tuple, secrets.dedup_matches(once).collect())) == sorted(map(tuple, once.collect()))


def test_env_files(spark):
    paths = [".env", ".env.example", ".env.local", ".env.json", "a/node_modules/.env", "a/.env"]
    got = secrets.env_file_match(scan_files(files_df(spark, [("r", p, "X=1") for p in paths]))).collect()
    assert sorted(r.path for r in got) == [".env", ".env.json", "a/.env"]
    assert {(r.severity, r.category, r.line) for r in got} == {("MEDIUM", "", 0)}


def test_order_is_total(spark):
    df = secrets.secret_findings(files_df(spark, ROWS))
    rows = secrets.sort_findings(df.repartition(5), ["repo"]).collect()
    again = secrets.sort_findings(df.repartition(3), ["repo"]).collect()
    assert rows == again
    ranks = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}
    keys = [(r.repo, ranks[r.severity], r.path, r.line, r.rule_ord, r.match_pos) for r in rows]
    assert keys == sorted(keys)


def test_entropy_tokens(spark):
    tie = "".join(chr(65 + i) for i in range(16)) + "".join(chr(97 + i) * 2 for i in range(8))
    texts = [("tie", f"k = '{tie}'"), ("short", f"'{tie[:31]}'"), ("hex", "'" + "0123456789abcdef" * 4 + "'"),
             ("under", f"'{tie[:-1]}_'"), ("twice", f"'{tie}' '{tie}' \"{tie}\"")]
    df = spark.createDataFrame(texts, "text_id string, text string")
    got = [(r.text_id, r.match) for r in entropy_secrets(df).collect()]
    shown = tie[:6] + "···" + tie[-4:]
    assert sorted(got) == [("tie", shown), ("twice", shown)]
    desc = entropy_secrets(df).filter("text_id = 'tie'").first().description
    assert "(entropy=4.50 bits/char)" in desc


def test_analyze_text_keeps_rule_order(spark):
    df = spark.createDataFrame([("t", "EVAL(x); Password = \"y\"; open(z)"), ("n", "nothing here")], "text_id string, text string")
    rows = analyze_text(df).orderBy("rule_ord").collect()
    assert [r.match for r in rows] == ["eval(", "open(", "PASSWORD", 'password = "']
    assert {r.text_id for r in rows} == {"t"}


def test_corpus_from_directories(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    for name, text in ((".env", "A=1"), ("x.lock", "no"), ("node_modules/y.js", AKEY), ("requirements.txt", "flask==1.0")):
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe ok\n" + AKEY.encode())
    (tmp_path / "big.py").write_bytes(b"x" * 512_001)
    df = src_file_corpus(spark, {"r": str(tmp_path)})
    rows = {r.path: r.content for r in df.collect()}
    assert sorted(rows) == [".env", "bad.py", "requirements.txt"]
    assert rows["bad.py"].startswith("�� ok")
    assert secrets.secret_findings(df).filter(F.col("path") == "bad.py").count() == 1


def test_corpus_of_subtrees(spark, tmp_path):
    files = {f"a/b{i % 5}/c{i % 3}/f{i}.py": f"x = {i}" for i in range(60)} | {"top.py": "é", "deep/" + "d/" * 60 + "z.py": "z", ".git/h.py": "no"}
    for name, text in files.items():
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_text(text)
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "one.js").write_text("1")
    (tmp_path / "s" / "gone.js").symlink_to(tmp_path / "nowhere")
    (tmp_path / "s" / "two.js").symlink_to(tmp_path / "s" / "one.js")
    (tmp_path / "s" / "loop").symlink_to(tmp_path / "s")
    repos = {"r": str(tmp_path / "r"), "s": f"file://{tmp_path}/s", "none": str(tmp_path / "none")}
    want = {("r", n): t for n, t in files.items() if ".git" not in n} | {("s", "one.js"): "1", ("s", "two.js"): "1"}
    for subtrees, chunk in ((1, 10), (6, 100), (1000, 1 << 20)):
        rows = src_file_corpus(spark, repos, subtrees=subtrees, chunk_bytes=chunk).collect()
        assert {(r.repo, r.path): r.content for r in rows} == want and len(rows) == len(want)
        assert {r.path for r in rows if r.is_link} == {"two.js"}
        bad = {(r.repo, r.path): r.error for r in corpus_rejects(spark, repos, subtrees=subtrees, chunk_bytes=chunk).collect()}
        assert set(bad) == {("s", "gone.js"), ("none", "")} and all(e.startswith("FileNotFoundError") for e in bad.values())


def test_tree_round_trip(spark, tmp_path):
    df = files_df(spark, [("r", "a/x.py", "1\r\n"), ("r", ".env", "é"), ("q", "b/c/y.js", "")])
    assert write_tree(df, f"file://{tmp_path}/t") == 3
    back = src_file_corpus(spark, {r: f"file://{tmp_path}/t/{r}" for r in "rq"})
    assert {(r.repo, r.path, r.content) for r in back.collect()} == {(r.repo, r.path, r.content) for r in df.collect()}
