import random

import numpy as np
import pytest

from folioflow.llm import leaks as L, subjects as S
from folioflow.llm.features import hashed_words
from folioflow.llm.overlap import cross_split_overlaps, words
from folioflow.llm.tokens import TOKENIZERS, Encoder, encode, merge_long, merge_short
from pyspark.sql import functions as F

RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def encoder():
    return Encoder(RANKS)


def test_ids_equal_those_of_the_library(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    r = random.Random(5)
    texts = ["", " ", "\n\n", "it's  <|endoftext|> we'll", "ก้ำ🧾👩‍👩‍👧", "ab" * 4000]
    texts += ["".join(r.choice("abcdeéß ก้ำ🧾0019.-'\t\n​ \x1c\x85　İſ") for _ in range(r.choice([5, 60, 400]))) for _ in range(150)]
    assert [list(encoder(x)) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_long_words_merge_as_short_ones(encoder):
    r = random.Random(7)
    for n in (2, 30, 129, 700):
        for _ in range(20):
            w = bytes(r.choice(b"abcdefthe ing\xe0\xb8") for _ in range(n))
            assert merge_short(w, encoder.words.ranks) == merge_long(w, encoder.words.ranks)


def test_every_document_has_ids(spark):
    df = spark.createDataFrame([(1, "a b", 1), (2, None, 1), (3, "", 1), (None, "x", 1), (3, "", 1), (4, "z" * 200_000, 1)], "doc_id long, text string, ids int")
    got = encode(df, "doc_id", "text", RANKS)
    assert got.columns == ["doc_id", "ids"] and got.count() == 6
    by = {r.doc_id: r.ids for r in got.collect()}
    assert by[2] == [] and by[3] == [] and len(by[1]) == 2 and len(by[4]) > 1000
    assert encode(df.limit(0), "doc_id", "text", RANKS).count() == 0


ITEM = "After 144 days the standing charge remained unpaid together with 556 others; see FX-2997624. According to Enpimka, Locla Ltd took charge of the fuse board as noted under Q-6564283. To our surprise the terminal was handed over and the rate stayed with Dorquel House."
THAI = "ตามตราประทับ แผนกผู้ป่วยนอกชำรุดกลับมาพร้อมอีก30รายการ หน้า810 แจ้งว่าใบสั่งยาชำรุดกลับมาในนามของ ลบผลตรวจเลือดออกจากรายการในนามของ นับแผนกผู้ป่วยนอกได้437ชิ้นยกเว้นสำเนา หน้า651 หลังจาก331วัน นับทดสอบภูมิแพ้ได้766ชิ้น"
FILL = "Questions about the invoice go to the front desk on the second floor, where a clerk answers them every day. "


def misread(text, rate, seed):
    r = random.Random(seed)
    return "".join({"o": "0", "l": "1", "s": "5", "e": "c", "t": "f"}.get(c, c) if r.random() < rate * 3 else c for c in text)


def found(texts, items=((1, ITEM), (2, THAI)), least=0.5):
    return {(d, i) for d, i, _ in L.leaks_in(L.prepare_items(list(items)), texts, least)}


def test_leaks_in_every_disguise():
    half = ITEM[: len(ITEM) * 6 // 10]
    wrapped = "\n".join(ITEM[i : i + 40] + ("-" if ITEM[i + 39 : i + 40].isalpha() and ITEM[i + 40 : i + 41].isalpha() else "") for i in range(0, len(ITEM), 40))
    texts = [
        FILL + ITEM + FILL, FILL + ITEM.upper(), FILL + half + FILL, wrapped, ITEM.replace(" ", "  ").replace("e", "e​"), misread(ITEM, 0.03, 1), ITEM.replace(". ", ".\nPlease keep this sheet.\n"), ITEM.replace(" ", "\\n"), "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in ITEM),
        ITEM.replace("standing", "flat").replace("fuse", "main").replace("surprise", "regret"),
    ]
    assert found(texts) == {(i, 0) for i in range(len(texts))}
    assert found([FILL + THAI, THAI.replace(" ", "\n")]) == {(0, 1), (1, 1)}


def test_leaks_of_repeated_items_and_shared_passages():
    assert found([FILL + ITEM + FILL, FILL], items=[(n, ITEM) for n in range(3)]) == {(0, n) for n in range(3)}
    asked = [(n, f"{ITEM} {q}") for n, q in enumerate(("Who took charge of it?", "Where does the rate stay?", "How many days did it take?"))]
    assert found([FILL + ITEM + FILL, FILL], items=asked) == {(0, n) for n in range(3)}


def test_what_is_no_leak():
    short = ITEM[: len(ITEM) // 4]
    shuffled = " ".join(random.Random(3).sample(ITEM.split(), len(ITEM.split())))
    assert found([None, "", "   \n", FILL * 300, FILL + short + FILL, shuffled, "x" * 100_000]) == set()
    assert found([ITEM], items=[]) == set() and found([ITEM], items=[(1, None), (2, ""), (3, "short")]) == set()


def test_instruction_lines_are_no_part_of_an_item():
    head = "Read the scanned page and copy the marked field. "
    texts = [head + f"The {w} was sold." for w in ("car", "cow", "cup")] + ["Alone it stands. Yes."]
    assert L.strip_instructions(texts) == ["The car was sold.", "The cow was sold.", "The cup was sold.", "Alone it stands. Yes."]


def test_blocks_find_all_within_the_radius():
    r = random.Random(9)
    items = L.prepare_items([(1, ITEM), (2, FILL * 3)])
    probe = [int(x) for x in items.prints[::3]]
    for i in range(len(probe)):
        for _ in range(r.randrange(6)):
            probe[i] ^= 1 << r.randrange(64)
    probe = np.array(probe, np.uint64)
    t, i = L.near(items, probe)
    d = np.bitwise_count(probe[:, None] ^ items.prints[None, :])
    assert set(zip(t.tolist(), i.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(d <= L.RADIUS))))


def test_simhash_by_doubling_equals_the_plain_sum():
    h = L.shingle_hashes(np.array([ord(c) for c in ITEM], np.uint32))
    for n in (0, 7, len(h) - L.WINDOW):
        bits = sum(np.unpackbits(h[n + k : n + k + 1].view(np.uint8)).astype(int) for k in range(L.WINDOW))
        assert np.packbits(bits > L.WINDOW // 2).view(np.uint64)[0] == L.simhashes(h)[n]


def test_leak_rows(spark):
    df = spark.createDataFrame([(1, ITEM, 0), (2, None, 0), (1, ITEM, 0), (None, ITEM, 0)], "doc_id long, text string, item_id int")
    got = L.find_leaks(df, "doc_id", "text", [(5, ITEM)]).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 5), (1, 5)]
    assert L.find_leaks(df.limit(0), "doc_id", "text", [(5, ITEM)]).count() == 0


def test_overlaps_against_all_pairs(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = [], [[r.choice(vocabulary) for _ in range(60)] for _ in range(12)]
    for i in range(60):
        t = list(r.choice(base))
        a = r.randrange(0, 40)
        t = t[a : a + r.choice([6, 20, 40])] + [r.choice(vocabulary) for _ in range(r.randrange(30))]
        rows.append((i, " ".join(t), r.choice(["train", "test", "validation", None]), "s"))
    rows += [(90, None, "train", "s"), (91, "", "test", "s"), (None, rows[0][1], "test", "s")]
    df = spark.createDataFrame(rows, "id int, text string, split string, source string").withColumn("tok", words(F.col("text")))
    got = {(x.train_key, x.eval_key): x.covered for x in cross_split_overlaps(df, "id", "tok", "split", "source", k=4, w=3).collect()}
    runs = {}
    for i, a, s, _ in rows:
        for j, b, t, _ in rows:
            if s == "train" and t not in ("train", None) and a and b and i is not None and j is not None:
                x, y = a.split(), b.split()
                best = 0
                for p in range(len(x)):
                    for q in range(len(y)):
                        n = 0
                        while p + n < len(x) and q + n < len(y) and x[p + n] == y[q + n]:
                            n += 1
                        best = max(best, n)
                runs[(i, j)] = best
    assert {p for p, n in runs.items() if n >= 6} <= set(got)  # k + w - 1 tokens are always found
    assert all(runs[p] >= 4 and c >= min(runs[p], 6) for p, c in got.items())


def test_overlaps_of_hot_and_odd_rows(spark):
    rows = [(i, ["hot"], "train" if i % 2 else "test", "a") for i in range(120)] + [(200, [], "train", "a"), (201, None, "test", "a"), (202, ["hot"], None, "a"), (203, ["hot"], "test", "b")]
    df = spark.createDataFrame(rows, "id int, tok array<string>, split string, scope string")
    out = cross_split_overlaps(df, "id", "tok", "split", k=1, w=1, scope="scope")
    assert out.count() == 60 * 60 and out.select("train_key", "eval_key").distinct().count() == 3600


WORDS = {1: ["carrot", "butter", "cheddar", "biscuit"], 2: ["judge", "verdict", "appeal", "notary"], 3: ["penalty", "goalkeeper", "marathon", "racket"]}


def document(r, subjects, mention=None):
    lines = ["Invoice for the attention of the desk", "Date and number as noted"]
    for s in subjects:
        lines += [f"The {r.choice(WORDS[s])} was noted together with the box." for _ in range(4)]
    if mention:
        lines.append(f"Envelope marked {WORDS[mention][0]}")
    return "\n".join(lines + ["Please keep this sheet"])


def test_subjects_of_held_out_documents():
    r = random.Random(8)
    truth = [set(r.sample([1, 2, 3], r.choice([0, 1, 1, 2]))) for _ in range(240)]
    texts = [document(r, t, mention=r.choice([None, 1, 2, 3])) for t in truth]
    given = [set(t) for t in truth[:120]]
    given[3] = {2}  # a wrong label
    f = S.anchored_factors(texts[:120], given, [1, 2, 3])
    _, count, _, _ = S.mixtures(f, texts[120:])
    got = [{int(f.subjects[k]) for k in np.flatnonzero(c)} for c in count]
    assert sum(a == b for a, b in zip(got, truth[120:])) >= 117


def test_subject_rows(spark):
    r = random.Random(1)
    rows = [(i, document(r, [i % 3 + 1]), 0) for i in range(60)] + [(100, None, 0), (101, "", 0), (102, "   ", 0), (None, document(r, [1]), 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, subject_id int")
    labels = spark.createDataFrame([(i, i % 3 + 1) for i in range(30)] + [(0, 1), (None, 2), (5, None), (999, 1)], "doc_id long, subject_id long")
    f = S.fit(docs.select("doc_id", "text"), labels, [1, 2, 3], "doc_id", "text", "subject_id")
    got = {(x.doc_id, x.subject_id) for x in S.subject_areas(docs, "doc_id", "text", f).collect()}
    assert got == {(i, i % 3 + 1) for i in range(60)}
    assert S.subject_areas(docs.limit(0), "doc_id", "text", f).count() == 0
    empty = S.fit(docs.select("doc_id", "text"), labels.limit(0), [1, 2, 3], "doc_id", "text", "subject_id")
    assert S.subject_areas(docs, "doc_id", "text", empty).count() == 0


def test_words_of_odd_texts():
    text, unit, feature = hashed_words(["the cat. The cat", None, "", "cat​s soft­ly 12345", "ใบสั่งยา ใบสั่งยา"])
    assert set(text.tolist()) == {0, 3, 4}
    assert len(np.unique(unit[text == 0])) == 2 and len(np.unique(feature[text == 0])) == 2
    assert hashed_words([])[0].size == 0
    assert set(hashed_words(["cats"])[2]) <= set(feature[text == 3])
