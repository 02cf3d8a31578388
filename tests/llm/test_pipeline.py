import random
import string

import pytest

import corpus_pipeline as p
from linescan.llm import jaccard, language_id, packing, secrets_scan, toxicity
from linescan.llm.tables import keep
from tests.conftest import DATA
from tests.llm.test_jaccard import brute
from tests.llm.test_packing import check_places
from tests.llm.test_secrets import brute as brute_secrets

DATA = DATA.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in p.STAGES:
        out.append(keep(stage(spark, out[-1], DATA), name))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_order_and_columns(stages):
    assert [n for n, _ in p.STAGES] == ["language", "toxicity", "near_duplicates", "secrets", "packing"]
    for df in stages[:-1]:
        assert df.columns == p.COLUMNS


def test_language_and_toxicity_stages(spark, stages):
    found = language_id.with_language(stages[0], language_id.trained_on(stages[0]), ["doc_id"])
    assert ids(stages[1]) == ids(found.where("lang_pred <> 'und' AND score >= 0.5")) and len(ids(stages[1])) > 900
    scored = toxicity.with_toxicity(stages[1], toxicity.trained_on(stages[1], spark.read.parquet(f"{DATA}/labels.parquet")), ["doc_id"])
    assert ids(stages[2]) == ids(scored.where("score < 0.7"))
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    gone = ids(stages[1]) - ids(stages[2])
    assert len([d for d in gone if labels.get(d) == 1]) >= 8 and len([d for d in gone if labels.get(d) == 0]) < 8


def test_near_duplicate_stage(stages):
    classes = brute([(r.doc_id, r.text) for r in stages[2].collect()])
    assert ids(stages[3]) == {i for i, (c, _) in classes.items() if i == c} and len(ids(stages[3])) < len(classes)


def test_secret_stage(stages):
    before = {r.doc_id: r.text for r in stages[3].collect()}
    changed = 0
    for r in stages[4].collect():
        spans = brute_secrets(before.pop(r.doc_id))
        changed += bool(spans)
        assert ("[SECRET]" in r.text) == bool(spans) and not brute_secrets(r.text) and r.n_chars == len(r.text)
    assert not before and changed > 3


def test_packing_stage(stages):
    rows = stages[5].collect()
    n = check_places(rows, 1024)
    assert {r.doc_id for r in rows} == ids(stages[4]) and n <= -(-sum(r.length for r in rows) // 1024) + 2


def test_edge_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "", None, "s", None), (3, "token=abcdefgh12 the of", "en", None, 3), (3, "token=abcdefgh12 the of", "en", None, 3), (None, "the of and", "en", "s", 1), (None, "the of and", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in p.STAGES:
        assert stage(spark, docs.where("false"), DATA).count() == 0, name
    by = {name: stage(spark, docs, DATA).collect() for name, stage in p.STAGES}
    assert {r.doc_id for r in by["language"]} <= {3, None}
    assert sorted((r.doc_id or 0) for r in by["near_duplicates"]) == [0, 0, 1, 2, 3]
    assert sorted(r.text or "" for r in by["secrets"]) == ["", "", "[SECRET] the of", "[SECRET] the of", "the of and", "the of and"]
    assert len(by["packing"]) == 6


def test_no_key_body_survives(spark):
    rng = random.Random(5)
    body = ["".join(rng.choices(string.ascii_letters + string.digits + "+/", k=64)) for _ in range(20)] + ["Zm9vYmFyCg=="]
    head, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    lines = "\n".join(body)
    crypt = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123-AB\n\n"
    texts = {
        f"see\n{head}\n{lines}\n{end}\nthe rest": "see\n[SECRET]\nthe rest",
        f"see\r\n{head}\r\n{lines.replace(chr(10), chr(13) + chr(10))}\r\n{end}\r\nthe rest": "see\r\n[SECRET]\r\nthe rest",
        f"{head}\n{crypt}{lines}\n{end} the rest": "[SECRET] the rest",
        f'k = "{head}\\n{lines.replace(chr(10), chr(92) + "n")}\\n{end}" the rest': 'k = "[SECRET]" the rest',
        f"> {head}\n> {lines.replace(chr(10), chr(10) + '> ')}\n> {end}\nthe rest": "> [SECRET]\nthe rest",
        f"{head} {' '.join(body)} {end} the rest": "[SECRET] the rest",
        # the END line is missing
        f"see {head}\n{lines}\nthe rest of it": "see [SECRET]\nthe rest of it",
        f"{head}\n{lines[:-5]}": "[SECRET]",
        f"{head}\n{crypt}{lines}\nthe rest of it": "[SECRET]\nthe rest of it",
        f'"{head}\\n{lines.replace(chr(10), chr(92) + "n")}" the rest': '"[SECRET]" the rest',
        f"{head} {' '.join(body)} the rest": "[SECRET] the rest",
        f"{head}\n{body[0]}\n{head}\n{lines}\n{end}\nthe rest": "[SECRET]\n[SECRET]\nthe rest",
        f"{head} the rest": "[SECRET] the rest",
        f"secret: {head}\n{lines}\n{end}\nthe rest": "[SECRET]\nthe rest",
        f"{head}\n{lines * 300}\n{end}\nthe rest": "[SECRET]\nthe rest",  # 400 KB
        f"{head}\n" * 1_000: "[SECRET]\n" * 1_000,
    }
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in p.without_secrets(spark, docs, DATA).collect()}
    for i, (before, after) in enumerate(texts.items()):
        assert got[i].text == after and got[i].n_chars == len(after), before[:200]


def test_repeated_ids_are_judged_text_by_text(spark):
    long = lambda name: [f"{name}{i}" for i in range(100)]
    text = lambda name, last="end": " ".join([*long(name), last])
    rows = [
        (1, text("a")), (5, text("a", "other")), (5, text("b")),  # one of 5's texts is a copy of 1's
        (6, text("c")), (6, text("d")), (6, text("d")), (7, text("c")),  # 6 has two texts, one of them twice
        (8, text("e")), (8, text("e", "other")), (9, text("e")),  # near copies under one id
        (10, None), (10, text("f")), (10, text("a")), (11, None), (11, ""), (12, text("f")),
        (None, text("g")), (None, text("a")),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in p.near_duplicates(spark, docs.repartition(3), DATA).collect()]
    assert len([1 for i, t in got if i == 8 and t in (text("e"), text("e", "other"))]) == 1 and len([1 for i, t in got if i == 11 and not t]) == 1
    rest = [(i, t) for i, t in got if i not in (8, 11)]
    kept = [(1, text("a")), (5, text("b")), (6, text("c")), (6, text("d")), (10, None), (10, text("f")), (None, text("g")), (None, text("a"))]
    assert sorted(rest, key=str) == sorted(kept, key=str)


def test_long_texts_and_clashing_columns(spark):
    """Names that the stages use inside, and texts of a megabyte with a secret at the end or nothing but blanks."""
    long = "the of and to in is " * 50_000 + "token=abcdefgh12"
    rows = [(1, long), (2, "the of and to in " * 40), (3, " " * 1_200_000), (4, "the of and to in " * 40)]
    extra = "cid binary, score double, blob string, seq long, pid long, label string, root string, length int, spans string, hit string"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), b"c", 1.0, "b", 1, 2, "l", "r", 3, "x", "h") for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    by = {name: stage(spark, docs, DATA).collect() for name, stage in p.STAGES}
    assert {r.doc_id for r in by["language"]} == {1, 2, 4} and {r.doc_id for r in by["toxicity"]} >= {2, 3, 4}
    assert {r.doc_id for r in by["near_duplicates"]} == {1, 2, 3}
    assert {r.doc_id: r.text for r in by["secrets"]}[1] == long.replace("token=abcdefgh12", "[SECRET]")
    assert {r.doc_id for r in by["packing"]} == {1, 2, 3, 4} and sum(r.length for r in by["packing"] if r.doc_id == 3) > 1000
    for name, _ in p.STAGES[:-1]:
        assert all(r.asDict().keys() == set(p.COLUMNS) for r in by[name])


def test_which_of_repeated_rows_stays(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, "en", "b", 5), (1, long, "en", "a", 7), (1, long, "de", "a", 7), (2, "some other text of six words", None, "z", 1), (2, "some other text of six words", "en", "z", 1)]
    for given in (rows, rows[::-1]):
        docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        kept = sorted((r.doc_id, r.lang, r.source, r.n_chars) for r in p.near_duplicates(spark, docs, DATA).collect())
        assert kept == [(1, "de", "a", 7), (2, None, "z", 1)]
