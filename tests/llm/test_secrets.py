import random
import re

from pyspark.sql import functions as F

from linescan.llm import secrets_scan as s

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute(text):
    out = []
    text = text or ""
    out += [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    out += [(m.start(), 3, m.end(), "pem") for m in re.finditer(r"-----BEGIN [A-Z ]*PRIVATE KEY-----", text)]
    return sorted(out)


def texts():
    rng = random.Random(3)
    bits = ["password=", "Secret: ", "token", "api_key", "APIKEY", '"', "'", " ", ":", "=", "AKIA", "ABCD1234", "deadbeef" * 2, "0" * 16, "é😀", "\n", "x_y.z-/+", "-----BEGIN RSA PRIVATE KEY-----", "q"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    return [*made, None, "", "AKIA" * 5, "token=secret: abcdefgh", "a" * 200_000, "passwordpassword=abcdefgh"]


def test_spans_and_redaction(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id int, text string, blob string")
    found, _ = s.scan_secrets(docs)
    joined = found.join(docs.drop("blob"), "doc_id").select("doc_id", "text", "spans", s.redact(F.coalesce("text", F.lit("")), F.col("spans")).alias("clean")).collect()
    assert len(joined) == len(rows)
    for r in joined:
        want = brute(r.text)
        assert [tuple(x) for x in r.spans] == want, r.text
        clean, at = "", 0
        for a, _, z, _ in want:
            if a >= at:
                clean += (r.text or "")[at:a] + "[SECRET]"
            at = max(at, z)
        assert r.clean == clean + (r.text or "")[at:]


def test_ledger_scans_only_what_is_new(spark):
    first = spark.createDataFrame([(1, "token=abcdefgh1"), (2, "plain")], "doc_id int, text string")
    _, one = s.scan_secrets(first)
    assert one.count() == 2 * len(s.RULES)
    both = first.union(spark.createDataFrame([(3, "token=abcdefgh1"), (4, "secret: zyxwvuts")], "doc_id int, text string"))
    found, two = s.scan_secrets(both, one)
    assert two.count() == len(s.RULES) and two.select("blob").distinct().count() == 1
    assert {r.doc_id: len(r.spans) for r in found.collect()} == {1: 1, 2: 0, 3: 1, 4: 1}
    newer = [(k, v + (k == "hex"), p, m) for k, v, p, m in s.RULES]
    again, three = s.scan_secrets(both, one.unionByName(two), newer)
    assert {(r.kind, r.version) for r in three.collect()} == {("hex", 2)} and three.count() == 3
    assert {r.doc_id: len(r.spans) for r in again.collect()} == {1: 1, 2: 0, 3: 1, 4: 1}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id int, text string")
    found, added = s.scan_secrets(none)
    assert found.count() == 0 and added.count() == 0


def test_dense_texts_take_linear_time(spark):
    import time

    dense = "".join(f"token=abcdefg{i}é " for i in range(100_000))
    mixed = "".join(f"token=AKIA{'0' * 40}{i} \U0001f600" for i in range(3000)) + "x" * 5000 + "password:12345678"
    docs = spark.createDataFrame([(1, dense), (2, mixed)], "doc_id int, text string")
    began = time.monotonic()
    found = s.scan_secrets(docs)[0].join(docs, "doc_id").select("doc_id", "text", "spans", s.redact(F.col("text"), F.col("spans")).alias("clean"))
    got = {r.doc_id: r for r in found.collect()}
    assert time.monotonic() - began < 40
    assert len(got[1].spans) == 100_000 and got[1].clean == "[SECRET]é " * 100_000
    for k in (1, 2):
        assert [tuple(x) for x in got[k].spans] == brute(got[k].text)
    assert got[2].clean == "[SECRET] \U0001f600" * 3000 + "x" * 5000 + "[SECRET]"


def test_two_deliveries_and_one_agree(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())] + [(None, "token=abcdefgh1"), (7, "token=abcdefgh1")], "doc_id int, text string")
    rows = lambda found: sorted(map(str, found.select("doc_id", "blob", "spans").collect()))
    whole, all_rows = s.scan_secrets(docs)
    _, ledger = s.scan_secrets(docs.where("doc_id % 2 = 0"))
    after, added = s.scan_secrets(docs, ledger)
    assert rows(after) == rows(whole)
    assert ledger.join(added, ["blob", "kind"]).count() == 0 and ledger.count() + added.count() == all_rows.count()
