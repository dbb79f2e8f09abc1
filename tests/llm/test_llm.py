import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import abuse, encode, leakage, linkage, names, pii, scannoise

# Encoding ---------------------------------------------------------------------------------------------------------------

TEXTS = [None, "", "   ", "\n", "Hello world", "  two  spaces ", "it's we'll I'VE", "a\n\nb \n c\t\td", "<|endoftext|> is text", "naïve café 漢字 \U0001f642 สวัสดี", "x y　z w", "a" * 5000, "____" * 90 + " 1234567890", "\x00\x1c\x85 odd"]


@pytest.fixture(scope="module")
def bpe():
    return encode.ByteBpe(encode.tokenizer_path())


def test_encoding_equals_the_reference_library(bpe):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(encode.tokenizer_path())
    t.encode_special_tokens = True
    r = random.Random(3)
    noise = ["".join(r.choice("ab \n.'sA1é漢_ -") for _ in range(r.randrange(60))) for _ in range(300)]
    texts = TEXTS + noise
    offsets, ids = bpe.encode(texts)
    for i, x in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == t.encode(x or "", add_special_tokens=False).ids, x
    assert bpe.decode([ids[a:z].tolist() for a, z in zip(offsets, offsets[1:])]) == [x or "" for x in texts]


def test_encode_corpus(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r["ids"] for r in encode.encode_corpus(df, "doc_id", "text", encode.tokenizer_path()).collect()}
    assert got[0] == [] and got[1] == [] and len(got) == len(TEXTS)
    assert encode.encode_corpus(df.limit(0), "doc_id", "text", encode.tokenizer_path()).count() == 0
    assert encode.roundtrip(df, "doc_id", "text", encode.tokenizer_path()).where("NOT same").count() == 0


# Leakage ------------------------------------------------------------------------------------------------------------------


def _prose(r, n):
    return " ".join("".join(r.choice("bcdfgklmnprstvz") + r.choice("aeiou") for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_winnowing_keeps_the_guarantee():
    r = random.Random(1)
    raw = np.frombuffer(leakage.squeeze(_prose(r, 300)), np.uint8)
    h = leakage.run_hashes(raw, leakage.K)
    at = set(leakage.winnow(h).tolist())
    assert all(any(i + j in at for j in range(leakage.WINDOW)) for i in range(len(h) - leakage.WINDOW + 1))
    brute = [int.from_bytes(raw[i : i + leakage.K].tobytes(), "big") for i in range(len(raw) - leakage.K + 1)]
    assert len(set(brute)) == len(set(h.tolist()))


def test_leaks(spark):
    r = random.Random(5)
    items = [_prose(r, 120) for _ in range(8)]
    part = lambda x, a, z: " ".join(x.split()[a:z])
    noisy = " ".join(w if i % 9 else w[:-1] + "x" for i, w in enumerate(items[3].split()))
    docs = [
        (0, None), (1, ""), (2, _prose(r, 400)), (3, _prose(r, 90) + " " + items[0].upper().replace(" ", "\n ") + "."), (4, part(items[1], 20, 62)), (5, part(items[2], 0, 7)),
        (6, noisy), (7, part(items[4], 0, 30) + " " + _prose(r, 60) + " " + part(items[4], 70, 100)), (8, items[5] + " " + items[6]), (3, items[0]), (9, "x"),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1))
    ev = spark.createDataFrame([*enumerate(items), (98, None), (99, " ")], "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]) for x in leakage.find_leaks(df, ev).collect()}
    assert got == {(3, 0), (4, 1), (6, 3), (7, 4), (8, 5), (8, 6)}
    assert leakage.find_leaks(df, ev.limit(0)).count() == 0 and leakage.find_leaks(df.limit(0), ev).count() == 0


def test_leaks_against_brute_force(spark):
    """Every document that holds an item's quarter word for word comes out, however full the filter is, and none that holds none of it."""
    r = random.Random(6)
    items = [_prose(r, 100) for _ in range(40)]
    docs, want = [], set()
    for i in range(120):
        k = i % 40
        a = r.randrange(60)
        n = r.choice([0, 10, 30, 40])
        docs.append((i, _prose(r, 30) + " " + " ".join(items[k].split()[a : a + n]) + " " + _prose(r, 30)))
        if n >= 30:
            want.add((i, k))
    df, ev = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    assert {(x["doc_id"], x["item_id"]) for x in leakage.find_leaks(df, ev).collect()} == want


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    r = random.Random(7)
    items = [_prose(r, 100) for _ in range(5)]
    df = spark.createDataFrame([(i, x + " " + _prose(r, 30)) for i, x in enumerate(items)] + [(9, _prose(r, 200))], "doc_id bigint, text string")
    monkeypatch.setattr(leakage, "BLOOM_BITS", 64)
    assert {(x["doc_id"], x["item_id"]) for x in leakage.find_leaks(df, spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")).collect()} == {(i, i) for i in range(5)}


def test_repeated_passages_keep_every_chain():
    """An item found after very many repeats of one of its phrases is still found."""
    r = random.Random(9)
    words = _prose(r, 100).split()
    item = leakage.Item(" ".join(words))
    text = (" ".join(words[3:10]) + " " + _prose(r, 5) + " ") * 200 + " ".join(words[40:80])
    assert leakage.held_words(leakage.squeeze(text), item) >= 40


def test_wide_leaks_are_no_stock(spark):
    """An item in many documents or copies still comes out, with its lesser leaks; stock prose that an item holds does not."""
    r = random.Random(8)
    items = [_prose(r, 120) for _ in range(3)]
    part = lambda x, a, z: " ".join(x.split()[a:z])
    page = _prose(r, 50) + " " + part(items[1], 10, 60)
    docs = [items[0] + " " + _prose(r, 40) for _ in range(50)] + [page] * 80 + [_prose(r, 60) + " " + part(items[2], 40, 47) for _ in range(60)] + [_prose(r, 80) for _ in range(60)]
    docs += [part(items[0], 30, 66), part(items[1], 5, 45), part(items[2], 30, 70)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]) for x in leakage.find_leaks(df, spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")).collect()}
    assert got == {(i, 0) for i in range(50)} | {(i, 1) for i in range(50, 130)} | {(250, 0), (251, 1), (252, 2)}


# Offensive content ----------------------------------------------------------------------------------------------------------

BAD = ["You are a worthless idiot and everybody knows it.", "Shut your mouth you moron.", "Those people are vermin and should be driven out."]
GOOD = ["The motion is denied.", "Rats were found in the kitchen and photographed.", "The county moved for adequate protection.", "My account was charged twice and that is not fair."]


def _training(r, n):
    texts, y = [], []
    for i in range(n):
        bad = i % 4 == 0
        s = [r.choice(GOOD) for _ in range(6)]
        if bad:
            s.insert(r.randrange(6), r.choice(BAD))
        texts.append(" ".join(s))
        y.append(bad)
    return texts, np.array(y)


def test_fit_finds_the_sentence():
    r = random.Random(2)
    texts, y = _training(r, 300)
    scorer = abuse.fit(texts, y)
    words = abuse.Words(scorer.known, scorer.masked)
    z = lambda s: scorer.logits([words.codes(s)])[0].max()
    assert all(z(s) > 0 for s in BAD) and all(z(s) < 0 for s in GOOD)
    assert z("YOU ARE A WORTHL3SS 1D10T AND EVERYBODY KNOWS IT") > 0 and z("you are a worthless i d i o t and everybody knows it") > 0 and z("you are a worthless id​iot and everybody knows it.") > 0


def test_held_out_accuracy():
    r = random.Random(4)
    scorer = abuse.fit(*_training(r, 300))
    texts, y = _training(r, 200)
    z, of, _ = scorer.logits([abuse.Words(scorer.known, scorer.masked).codes(t) for t in texts])
    best = np.full(len(texts), -99.0)
    np.maximum.at(best, of, z)
    assert ((best > 0) == y).mean() > 0.97


def test_score_documents(spark):
    r = random.Random(2)
    texts, y = _training(r, 200)
    rows = [(i, t, "S") for i, t in enumerate(texts)] + [(900, None, "s"), (901, "", "s"), (902, "  ", None), (903, GOOD[0] + " " + BAD[0] + " " + GOOD[1], "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, "abusive" if b else "none") for i, b in enumerate(y)] + [(0, "none"), (5, None), (777, "sexual")], "doc_id bigint, label string")
    got = {x["doc_id"]: x for x in abuse.score_documents(docs, labels, extra=("score",)).collect()}
    assert got[900]["score"] == got[901]["score"] == got[902]["score"] == 0 and got[900]["worst"] == 0
    assert got[903]["score"] > 0.5 and got[903]["worst"] == 2 and got[903]["in_score"] == "s"
    assert abuse.score_documents(docs.limit(0), labels).count() == 0
    assert abuse.score_documents(docs, labels.limit(0)).where("score >= 0.25").count() == 0


def test_two_doubtful_sentences_add_up_and_long_ones_keep_their_number(spark):
    r = random.Random(2)
    texts, y = _training(r, 200)
    long = " ".join(["the county moved for adequate protection"] * 40) + ". " + BAD[0] + " And so on."
    docs = spark.createDataFrame([*enumerate(texts), (900, long), (901, " ".join([BAD[0], GOOD[0]])), (902, " ".join([BAD[0], GOOD[0], BAD[1]]))], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, "abusive" if b else "none") for i, b in enumerate(y)], "doc_id bigint, label string")
    got = {x["doc_id"]: x for x in abuse.score_documents(docs, labels).collect()}
    assert got[900]["worst"] == 2 and got[900]["sentences"] == 3
    assert got[902]["score"] > got[901]["score"] and got[902]["sentences"] == 3


# Personal information ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def finder():
    return pii.Finder(["Helen", "Marcus", "Rosa"])


@pytest.mark.parametrize(
    "text, want",
    [
        ("", []),
        ("The witness, Helen Q. Ormgate, spoke.", [("NAME", "Helen Q. Ormgate")]),
        ("Notices to Dr. Ormgate, Marcus, 12 Elm Street, Oakfen, TA 12345.", [("NAME", "Ormgate, Marcus"), ("ADDRESS", "12 Elm Street, Oakfen, TA 12345")]),
        ("Mr. J. Ormgate Jr. then left.", [("NAME", "J. Ormgate Jr.")]),
        ("Ormgate v. Helen Tarn", []),
        ("moved to Rosa Hall in Helen County; (S.D. Arda. 2018)", []),
        ("counsel for Rosa Kestrel Foods Inc. said", []),
        ("call me at (404) 555-0100 or 404.555.0101", [("PHONE", "(404) 555-0100"), ("PHONE", "404.555.0101")]),
        ("+1 404 555 0100", [("PHONE", "+1 404 555 0100")]),
        ("Part 555-6403 and account no. 4045550100 and 1:20-cv-04045", []),
        ("SSN 123-45-6789, SSN xxx-xx-6789", [("ID", "123-45-6789")]),
        ("SSN: 987654321; passport no.\nX1234567", [("ID", "987654321"), ("ID", "X1234567")]),
        ("alien registration number A 123 456 789", [("ID", "A 123 456 789")]),
        ("driver's license K 597-5577", [("ID", "K 597-5577")]),
        ("write to a.b+c@mail.example, or x (at) y [dot] org", [("EMAIL", "a.b+c@mail.example"), ("EMAIL", "x (at) y [dot] org")]),
        ("mailto:jo@x.test <jo@x.test> @handle", [("EMAIL", "jo@x.test"), ("EMAIL", "jo@x.test")]),
        ("at P.O. Box 12, Vantry, QU 12345 and Rural Route 5, Box 9", [("ADDRESS", "P.O. Box 12, Vantry, QU 12345"), ("ADDRESS", "Rural Route 5, Box 9")]),
        ("7116 West 19th\nDrive, # 4", [("ADDRESS", "7116 West 19th\nDrive, # 4")]),
        ("corner of Larch Road and Elm Street; abuts Route 51; 286 Prov. Ct. 12", []),
        ("The witness, Helen\n- 7 -\nAmes v. Bell          No. 12-503\nOrmgate, spoke at\nlength.", [("NAME", "Helen\n- 7 -\nAmes v. Bell          No. 12-503\nOrmgate")]),
        ("Hel-\nen Ormgate left", [("NAME", "Hel-\nen Ormgate")]),
        ("Dr. Zorvath Quimperle and Xanthe Y. Brocade spoke", [("NAME", "Zorvath Quimperle"), ("NAME", "Xanthe Y. Brocade")]),
        ("call 4046340100 or 4046340101, see 4046340102", [("PHONE", "4046340100"), ("PHONE", "4046340101")]),
        ("see https://x.test/a?n=404-634-0100 and mailto:jo.q@x.test", [("EMAIL", "jo.q@x.test")]),
        ("write to " + "a" * 200 + "@mail.example", [("EMAIL", "a" * 200 + "@mail.example")]),
    ],
)
def test_pii(finder, text, want):
    assert [(k, text[s:e]) for k, s, e in finder.find(text)] == want


def test_contact_blocks(finder):
    find = lambda t: [t[s:e] for k, s, e in finder.find(t, True) if k == "NAME"]
    assert find("JS Tarnmont\r\nTarn & Co LLP") == ["JS Tarnmont"] and find("Heleen Tarnmont\nX LLP") == ["Heleen Tarnmont"] and find("marcus tarnmont, X LLP") == ["marcus tarnmont"]
    assert find("P. M. Tarnmont\r\n17 Elm St.") == ["P. M. Tarnmont"] and find("rosa tarnmont Sr\r\nX LLP")[0].startswith("rosa tarnmont") and find("TO Tarnmont\nX LLP") == ["TO Tarnmont"]
    assert find("Tarn Mont Legal Aid Society\n(o) (404) 555-0100") == [] and find("c/o Tarn, Mont & Associates") == []


def test_any_number_of_given_names(monkeypatch):
    """With more names than the automaton takes, words are looked up instead: the same finds."""
    names_ = [f"Zq{''.join(chr(97 + int(d)) for d in str(i))}" for i in range(100_001)]
    text = f"Then {names_[7]} Ormgate met {names_[-1]} Tarnmont in Oakfen."
    many = pii.Finder(names_)
    assert not many.listed and many.find(text) == pii.Finder([names_[7], names_[-1]]).find(text) and len(many.find(text)) == 2


def test_firm_words_come_from_captions(spark):
    rows = [(f"{w} v. {h} Gadgets Inc.",) for w in ("Helen", "Rosa", "Ann", "Ida") for h in ("Tarn", "Mont", "Orm", "Vell", "Dune", "Ferr")] + [("Ormgate v. Tarnmont Corp.",), (None,)]
    df = spark.createDataFrame(rows, "c string")
    assert pii.firm_words(df, "c", 5) == ["gadgets"] and pii.firm_words(df.limit(0), "c") == []
    assert pii.Finder(["Helen"], ["gadgets"]).find("Helen Gadgets said") == []


def test_redaction_leaves_the_rest(spark):
    df = spark.createDataFrame([(1, "Call Helen Tarn at 404-555-0100."), (2, None), (3, ""), (1, "Call Helen Tarn at 404-555-0100."), (4, "word " * 50_000)], "id bigint, t string").withColumn("row_id", F.lit(0))
    got = {r["row_id"]: r["redacted"] for r in pii.redact_column(df, "id", "t", ["helen"]).collect()}
    assert got[1] == "Call [NAME] at [PHONE]." and got[2] is None and got[3] == "" and got[4] == "word " * 50_000
    assert pii.find_pii(df, "s", "id", "t", ["helen"]).count() == 2
    assert pii.find_pii(df.limit(0), "s", "id", "t", []).count() == 0


# Scan noise ---------------------------------------------------------------------------------------------------------------------

PAGE = """Ames v. Bell          No. 12-503
The court finds that the motion was
granted and the judgment was en-
tered for the cross-
claimant after the hearlng
- 1 -
Ames v. Bell          No. 12-503
ended. The motion was denied and the
court f1nds that the judgment was
[2]
Ames v. Bell          No. 12-503
entered.
"""


@pytest.fixture(scope="module")
def reader():
    text = "the court finds that the motion was granted and the judgment was entered for the cross-claimant after the hearing ended denied " * 50
    k = scannoise.Counts()
    k.add(text)
    return scannoise.Reader(dict(k.rows()))


def test_noisy_lines(reader):
    got = scannoise.noisy_lines(PAGE, reader)
    assert got == [(1, "header"), (3, "hyphen"), (5, "char"), (6, "page_no"), (7, "header"), (9, "char"), (10, "page_no"), (11, "header")]
    assert scannoise.noisy_lines("", reader) == [] and scannoise.noisy_lines("one line of text", reader) == []


def test_long_lines_and_words_are_read_too(reader):
    """A line of any length switches nothing off; a page number may end in a stop, a number that ends a sentence is none."""
    long = " ".join(["the court finds that the motion was granted"] * 40)
    assert scannoise.noisy_lines(f"the court f1nds that\n{long}\n{long} and the judgmcnt was denied", reader) == [(1, "char"), (3, "char")]
    assert scannoise.noisy_lines("the court f1nds that " + "x" * 100_000, reader) == [(1, "char")]
    got = scannoise.noisy_lines("the motion was\n2.\nAmes v. Bell          No. 12-503\ngranted under section\n9.\nthe court on May 1,\n2013.\n", reader)
    assert (2, "page_no") in got and not {(5, "page_no"), (7, "page_no")} & set(got)
    assert "court finds that" in scannoise.repair(f"the court f1nds that\n{long}", reader)


def test_repair(reader):
    got = scannoise.repair(PAGE, reader)
    assert "entered for the cross-claimant after the hearing ended." in got and "court finds that" in got and "No. 12-503" not in got and "- 1 -" not in got


def test_find_noise(spark):
    good = "the court finds that the motion was granted and the judgment was entered for the cross-claimant after the hearing ended denied " * 20
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, good), (1, PAGE)], "id bigint, plain_text string").withColumn("src", F.lit("clash"))
    got = {tuple(r)[2:] for r in scannoise.find_noise({"x": (df, "id", "plain_text")}).where("row_id = 1").collect()}
    assert got == set(scannoise_expected())
    assert scannoise.find_noise({"x": (df.limit(0), "id", "plain_text")}).count() == 0
    assert scannoise.repair_texts(df, "id", "plain_text").where("row_id = 2 AND repaired IS NULL").count() == 1


def test_pairs_count_the_same_however_parted(spark):
    df = spark.createDataFrame([(f"repeatedly altered x{i}",) for i in range(12)], "t string")
    assert [scannoise.count_language(df.repartition(n)).get("repeatedly altered") for n in (1, 12)] == [12, 12]


def scannoise_expected():
    return [(1, "header"), (3, "hyphen"), (5, "char"), (6, "page_no"), (7, "header"), (9, "char"), (10, "page_no"), (11, "header")]


# Names ------------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Helen Q. Ormgate", "Ormgate, Helen", True),
        ("H. Ormgate", "Helen Ormgate", True),
        ("HQ Ormgate", "Helen Quinn Ormgate", True),
        ("Bob Ormgate", "Robert Ormgate", True),
        ("Helen Omrgate", "Helen Ormgate", True),
        ("Hon. Helen Ormgate, Jr.", "ORMGATE, HELEN", True),
        ("Helen Ormgate Sr.", "Helen Ormgate Jr.", False),
        ("Helen Ormgate", "Rosa Ormgate", False),
        ("Helen A. Ormgate", "Helen B. Ormgate", False),
        ("Helen Ormgate", "Helen Tarnmont", False),
        ("Ann Bea Cora Dora Eva Ormgate", "Eva Dora Cora Bea Ann Ormgate", True),
        ("Ann Bea Cora Dora Eva Ormgate", "Eva Dora Cora Bea Fay Ormgate", False),
        ("Helen Wong", "Helen Wang", True),
        ("Helen O'Brien", "Helen OBrien", True),
    ],
)
def test_alignment(a, b, same):
    got = names.align(names.parse(a), names.parse(b), names.Nicknames([]))
    assert (got is not None) == same


def test_alignment_finds_the_best_assignment():
    from itertools import permutations

    nick = names.Nicknames([])
    r = random.Random(3)
    parts = ["ann", "bob", "robert", "a", "b", "carl", "karl", "c"]
    for _ in range(200):
        x, y = r.sample(parts, 2), r.sample(parts, 3)
        want = min(sum(names._part_cost(p, q, nick) + (0.0 if i == y.index(q) else 0.3) for i, (p, q) in enumerate(zip(x, o))) for o in permutations(y, 2))
        got = names.align(names.Name(x, "tarn", ""), names.Name(y, "tarn", ""), nick)
        assert (got is None and want >= 9) or abs(got - want - 0.15) < 1e-9


def test_delete_keys_meet_within_one_edit(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abcd") for _ in range(r.randrange(4, 8))) for _ in range(80)]
    df = spark.createDataFrame([(w,) for w in words], "w string").distinct()
    keys = {x["w"]: set(x["k"]) for x in df.select("w", names.delete_keys(F.col("w")).alias("k")).collect()}
    for a in keys:
        for b in keys:
            if names.near(a, b) == 1:
                assert keys[a] & keys[b], (a, b)


def _people(spark):
    rows = [(1, "Helen", "Quinn", "Ormgate", "", None, "c1"), (2, "Lena", "", "Ormgate", "", 1, "c1"), (3, "Robert", "", "Tarnmont", "Jr.", None, "c1"), (4, "Rosa", "", "Tarnmont", "", None, "c2"), (5, "Ivan", "", "Loop", "", 6, "c1"), (6, "Ivan", "", "Loop", "", 5, "c1"), (1, "Helen", "Quinn", "Ormgate", "", None, "c1"), (7, "Ann", "", "Twin", "", None, "c1"), (8, "Ada", "", "Twin", "", None, "c1")]
    df = spark.createDataFrame(rows, "id bigint, name_first string, name_middle string, name_last string, name_suffix string, is_alias_of_id bigint, court_id string")
    return df.withColumn("date_start", F.lit(None).cast("date")).withColumn("date_termination", F.lit(None).cast("date"))


def test_judges(spark):
    typed = [(1, "c1", "Hon. H. Q. Ormgate"), (2, "c1", "Lena Ormgate"), (3, "c1", "TARNMONT, BOB"), (4, "c2", "Bob Tarnmont"), (5, "c1", "Unassigned"), (6, "c1", None), (7, "c1", ""), (8, "c1", "Ivan Loop"), (9, "c1", "Judge Twin"), (10, "C1 ", "Ann Twin"), (11, None, "Ann Twin"), (12, "c1", "Helen Omrgate"), (13, "c1", "A. Twin")]
    df = spark.createDataFrame(typed, "row_id bigint, court_id string, name string").withColumn("src", F.lit("s")).withColumn("date", F.lit(None).cast("date"))
    got = {r["row_id"]: r["person_id"] for r in names.link_judges(df, _people(spark)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 10: 7, 12: 1}
    assert names.link_judges(df.limit(0), _people(spark)).count() == 0


def test_surnames_of_any_form(spark):
    """Short, marked and many-word surnames have keys too."""
    rows = [(1, "Li", "Ng"), (2, "Sean", "O'Brien"), (3, "Ann", "Smith-Jones"), (4, "Piet", "Van Dyke"), (5, "Rosa", "De La Cruz"), (6, "Mei", "Wong")]
    people = spark.createDataFrame([(i, f, "", last, "", None, "c1") for i, f, last in rows], "id bigint, name_first string, name_middle string, name_last string, name_suffix string, is_alias_of_id bigint, court_id string")
    people = people.withColumn("date_start", F.lit(None).cast("date")).withColumn("date_termination", F.lit(None).cast("date"))
    typed = [(1, "Li Ng"), (2, "O'BRIEN, SEAN"), (22, "Sean OBrien"), (3, "Ann Smith Jones"), (33, "A. Smith-Jones"), (4, "Piet Van Dyke"), (44, "Judge VanDyke"), (5, "Rosa De La Cruz"), (6, "Mei Wang")]
    df = spark.createDataFrame([(i, "c1", n) for i, n in typed], "row_id bigint, court_id string, name string").withColumn("src", F.lit("s")).withColumn("date", F.lit(None).cast("date"))
    got = {r["row_id"]: r["person_id"] for r in names.link_judges(df, people).collect()}
    assert got == {1: 1, 2: 2, 22: 2, 3: 3, 33: 3, 4: 4, 44: 4, 5: 5, 6: 6}


def test_attorneys(spark):
    rows = [
        (1, "Helen Q. Ormgate", "Helen Ormgate\nTarn & Mont LLP\n404-555-0100", "(404) 555-0100", "", "h@x.test"),
        (2, "H. Ormgate", "Tarn & Mont LLP", "", "", ""),
        (3, "ORMGATE, HELEN", "", "404.555.0100", "", ""),
        (4, "Helen Ormgate", "Other Firm P.C.", "404-555-0199", "", "z@y.test"),
        (5, "Rosa Ormgate", "Tarn & Mont LLP", "404-555-0100", "", ""),
        (6, "Tarn & Mont LLP", "Tarn & Mont LLP", "", "", ""),
        (7, "Tarn and Mont L.L.P.", "", "", "", ""),
        (8, None, None, None, None, None),
        (9, "Helen Ormgate", "", "", "", "H@X.test"),
        (1, "Helen Q. Ormgate", "Helen Ormgate\nTarn & Mont LLP\n404-555-0100", "(404) 555-0100", "", "h@x.test"),
    ]
    df = spark.createDataFrame(rows, "id bigint, attorney_name string, contact_raw string, phone string, fax string, email string")
    got = {(r["id_a"], r["id_b"]) for r in names.class_pairs(names.attorney_classes(df, _people(spark))).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (1, 9), (2, 9), (3, 9), (6, 7)}
    assert names.attorney_classes(df.limit(0), _people(spark)).count() == 0


# Linkage ----------------------------------------------------------------------------------------------------------------------------


def test_numbers_of_any_spelling(spark):
    for s, want in [("5:15-cv-00353", ("15", "cv", "353")), ("CV13-01102", ("13", "cv", "1102")), (" 04-cv-00985 ", ("04", "cv", "985")), ("2018-CV-00388", ("18", "cv", "388")), ("15-00651-bk", ("15", "bk", "651")), ("1:12cv839", ("12", "cv", "839")), ("No. 09-bk-765", ("09", "bk", "765")), ("Civil Action No. 07-364", ("07", None, "364")), ("unknown", (None, None, None)), (None, (None, None, None))]:
        r = spark.createDataFrame([(s,)], "n string").select(linkage.number_parts(F.col("n")).alias("p")).first()["p"]
        assert (r["yy"], r["kind"], r["serial"]) == want, s


def test_linkage(spark):
    import datetime as dt

    r = random.Random(9)
    word = lambda: "".join(r.choice("bdgklmnprst") + r.choice("aeiou") for _ in range(4)).capitalize()
    dockets = [(i, r.choice(["arsd", "kesd", "qund"]), f"{word()} v. {word()} Foods Inc.", f"1:{r.randrange(10, 24)}-cv-{i + 100:05d}", dt.date(2010, 1, 1) + dt.timedelta(r.randrange(4000))) for i in range(200)]
    listed, want = [], set()
    for i, c, n, no, d in dockets[:150]:
        k = i % 5
        row = (1000 + i, c.upper() if k == 0 else c, n.replace("Foods", "Food") if k == 1 else n.upper(), no[2:].replace("-", "–") if k == 2 else "unknown" if k == 3 else no, None if k == 4 else d)
        listed.append(row)
        want.add((1000 + i, i))
    listed += [(5000 + i, c, f"{word()} v. {word()}", no, d + dt.timedelta(900)) for i, c, n, no, d in dockets[150:170]] + [(6000, None, None, None, None), (6001, "", " ", "", None)]
    schema = "id bigint, court_id string, case_name string, docket_number string, date_filed date"
    got = {(x["row_id"], x["docket_id"]) for x in linkage.link_dockets(spark.createDataFrame(listed, schema), spark.createDataFrame(dockets, schema)).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 2
    assert linkage.link_dockets(spark.createDataFrame([], schema), spark.createDataFrame(dockets, schema)).count() == 0


# Queries ------------------------------------------------------------------------------------------------------------------------------

import __spark_entry__ as entry  # noqa: E402

COLUMNS = {"p3_found": "src id_a id_b", "p4_found": "docket_id row_id", "p5_found": "src row_id pii_kind start_pos", "p7_found": "src row_id line_no noise_kind", "p8_ids": "doc_id ids", "p9_found": "doc_id item_id", "p10_found": "doc_id"}


@pytest.mark.parametrize("name", [n for n in entry.queries() if re.match(r"p(3|4|5|7|8|9|10)_", n)])
def test_queries_run(spark, data, name):
    df = entry.queries()[name](spark, data)
    assert name not in COLUMNS or df.columns == COLUMNS[name].split()
    assert df.count() > (-1 if name == "p10_found" else 0)  # the smallest tables may hold no offence


def test_both_tables_are_repaired(spark, data):
    got = entry.queries()["p7_repaired"](spark, data)
    assert got.columns == ["src", "row_id", "repaired"]
    rows = {r["src"]: r["n"] for r in got.groupBy("src").agg(F.count("*").alias("n")).collect()}
    assert rows == {t: spark.read.parquet(f"{data}/{t}.parquet").select("id").distinct().count() for t in ("recap_documents", "opinions")}


def test_repair_counts_the_language_of_all_tables(spark):
    good = "the court finds that the motion was granted and the judgment was entered for the cross-claimant after the hearing ended denied " * 20
    page, other = (spark.createDataFrame([(1, t)], "id bigint, plain_text string") for t in (PAGE, good))
    got = scannoise.repair_sources({"a": (page, "id", "plain_text"), "b": (other, "id", "plain_text")}).where("src = 'a'").first()["repaired"]
    assert "after the hearing ended." in got


def test_both_columns_are_redacted(spark, data):
    got = entry.queries()["p5_redacted"](spark, data)
    assert got.columns == ["src", "row_id", "redacted"]
    rows = {r["src"]: r["n"] for r in got.groupBy("src").agg(F.count("*").alias("n")).collect()}
    assert rows == {t: spark.read.parquet(f"{data}/{t}.parquet").count() for t in ("recap_documents", "attorneys")}
    holds = {tuple(r) for r in entry.queries()["p5_found"](spark, data).select("src", "row_id").distinct().collect()}
    marked = {tuple(r) for r in got.where(r"redacted RLIKE '\\[(NAME|ADDRESS|PHONE|EMAIL|ID)\\]'").select("src", "row_id").collect()}
    assert {"recap_documents", "attorneys"} == {s for s, _ in holds} and holds <= marked
