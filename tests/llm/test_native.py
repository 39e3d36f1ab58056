import random
import re
import zlib
from collections import Counter, defaultdict
from math import comb

import pytest
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, kd_shards, preferences, quality


def counts_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, awkward):
    odd = awkward.select("doc_id", "text").union(spark.createDataFrame([(200, "a b c d e f g h " * 5), (201, "x " * 40), (202, "l one\nl one\n \n \nl one |#"), (203, "a b c d e f g h i a b c d e f g h"), (204, "é\x0bü\x0c漢字\r\n\tx")], "doc_id long, text string"))
    rows = quality.with_counts(odd.withColumn("stratum", F.lit("s"))).collect()
    assert len(rows) == odd.count()
    for r in rows:
        want = counts_of(r["text"])
        assert tuple(r[c] for c in quality.BASE) == want, r["text"][:80]
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_a_document_is_one_label(spark):
    """Rows of one document are one trial, as its most rejected row; null and empty languages are two strata."""
    rows = [(1, "w" * 90 + " a" * 30, "en")] + [(1, " ".join(["abcde"] * 3 + [f"w{k}" for k in range(30)]), "en")] * 5 + [(2, " ".join(f"v{k}" for k in range(30)), None), (3, " ".join(f"u{k}" for k in range(30)), "")]
    stats = quality.with_counts(spark.createDataFrame(rows, "doc_id long, text string, stratum string"))
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 0), (9, 1)], "doc_id long, quality int")
    got = {r["stratum"]: (r["good"], r["bad"]) for r in quality.labelled_counts(stats, labels).collect()}
    assert got == {"en": (1, 0), None: (1, 0), "": (0, 1)}


@pytest.mark.parametrize(("good", "false", "step"), [(143, 0, None), (144, 0, 23), (400, 3, 23), (400, 20, 0)])
def test_steps_up_to_the_first_that_fails(spark, good, false, step):
    """Four strata at ALPHA 0.03 and DELTA 0.05: 144 good documents without a false rejection certify; 20 of 400 don't."""
    rows = [("en", 0, good - false, 0), ("en", 14 if false == 20 else 1, false, 0), ("en", 24, 0, 50), ("en", 1, 0, 10)] + [(x, 0, 5, 5) for x in ("de", "fr", None)]
    counts = spark.createDataFrame(rows, "stratum string, passed int, good long, bad long")
    got = quality.certified(counts).collect()
    assert [r["place"] for r in got] == ([] if step is None else [step])


@pytest.mark.parametrize(("k", "n"), [(0, 10), (3, 500), (12, 900), (40, 5000), (5, 20)])
def test_binomial_tail(spark, k, n):
    want = 1.0 if k > n * 0.01 else sum(comb(n, j) * 0.01**j * 0.99 ** (n - j) for j in range(k + 1))
    got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), 0.01)).first()[0]
    assert abs(got - want) < 1e-9


def test_cutoffs_are_certified_and_bad_documents_go(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(4000):
        bad = k % 8 == 0
        words = ["".join(rng.choice("abcdefgh") for _ in range(10 if bad else rng.choice([3, 4, 5, 6]))) for _ in range(30)]
        rows.append((k, " ".join(words), "en" if k % 2 or k % 8 == 0 else "de"))
        labels.append((k, None if k % 50 == 49 else int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.quality(docs, marks, ["doc_id", "text"]).select("_kept.doc_id", "kept", "failed_rules").collect()
    bad = [r for r in got if r["doc_id"] % 8 == 0]
    good = [r for r in got if r["doc_id"] % 8]
    assert sum(r["kept"] for r in bad) == 0 and sum(r["kept"] for r in good) >= 0.97 * len(good)


def test_nothing_is_certified_without_labels(spark, awkward, nothing):
    marks = spark.createDataFrame([], "doc_id long, quality int")
    docs = awkward.withColumn("lang", F.lit(None).cast("string"))
    rows = quality.quality(docs, marks, ["doc_id"]).collect()
    assert len(rows) == docs.count() and all(r["kept"] != r["base_failed"] for r in rows)
    assert quality.quality(nothing, marks, ["doc_id"]).count() == 0


ITEMS = [(1, "A train leaves Paris at 9 and travels 120 km in 2 hours toward Berlin while the other waits there. How fast is it going?"), (2, "the short item text"), (3, None), (4, "x y"), (5, "What is the name of the old river that runs through the middle of the town and ends in the sea")]


def test_decontamination(spark, nothing):
    docs = [
        (1, "Before it. " + ITEMS[0][1] + " After it."),
        (2, "Before it. A train leaves Rome at 7 and travels 300 miles in 5 hours toward Vienna while the other waits there. How fast is it going? Yes."),
        (3, "A train leaves Rome at 7 and travels 300 km in 5 hours toward Rome while the other waits there. How fast is it going?"),  # two slots, one value
        (4, "Nothing to see, here or there, of any kind at all in this text of some length."),
        (5, "we say the short item text now"),
        (6, None),
        (7, ""),
        (None, "what is the name of the old river that runs through the middle of the town and ends in the sea"),
        (8, "the name of the old river that runs dry"),
        (1, "again other text of the same id"),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("size", F.lit(1))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.matches(frame, items).collect()}
    assert {k for k, r in got.items() if r["contaminated"]} == {(1, 1), (2, 1), (5, 2), (None, 5)}
    assert not got[3, 1]["consistent"] and got[2, 1]["n_slots"] == 7
    assert sorted(r["text"] or "" for r in decontaminate.clean(frame, items).collect()) == sorted(t or "" for d, t in docs if d in (3, 4, 6, 7, 8) or (t or "").startswith("again"))
    assert decontaminate.matches(nothing, items).count() == 0
    assert decontaminate.clean(frame, spark.createDataFrame([], "item_id long, text string")).count() == len(docs)


def contaminated(spark, item, doc):
    docs = spark.createDataFrame([(k, d) for k, d in enumerate([doc] if isinstance(doc, str) else doc)], "doc_id long, text string")
    rows = decontaminate.matches(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    return {r["doc_id"] for r in rows if r["contaminated"]}


def test_each_text_is_judged_by_itself(spark):
    """Texts that share an id, or have none, don't add up and don't go together."""
    words = [f"w{k}x" for k in range(18)]
    item = " ".join(words)
    half = lambda k: "some other words before " + " ".join(words[k : k + 8]) + " and others after it"
    docs = [(1, half(0)), (1, half(9)), (1, "a clean text of the same document"), (2, half(0)), (None, "a clean text without an id"), (None, f"here: {item}"), (3, f"here: {item}"), (3, f"here: {item}"), (3, "clean"), (4, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.matches(frame, items).collect()}
    assert {k for k, r in rows.items() if r["contaminated"]} == {None, 3} and rows[1]["n_covered"] == rows[2]["n_covered"] == 8
    kept = [tuple(r) for r in decontaminate.clean(frame, items).collect()]
    assert sorted(kept, key=repr) == sorted((d for d in docs if d[1] is None or not d[1].startswith("here")), key=repr)


def test_short_items_and_items_without_words(spark):
    """Two words, one word, signs alone, and questions in scripts without spaces are found verbatim and not otherwise."""
    items = [(1, "Define entropy"), (2, "Photosynthesis?"), (3, "2 + 3 * 4 = ?"), (4, "水的沸点是多少度？"), (5, "+ - * ="), (6, "Compute 5"), (7, "  "), (8, "ราคาเท่าไหร่")]
    docs = [
        "please define  Entropy, now", "we define the entropy", "on photosynthesis and light", "photo synthesis", "so 2 + 3 * 4 = ? and", "so 2 + 3 * 5 = ? and", "题目：水的沸点是多少度？答案", "水的沸点是多少",
        "signs + -\n* = here", "signs + - = here", "compute 5 of them", "compute 6 of them", "ถามว่าราคาเท่าไหร่ครับ", "", None, "x" * 60_000 + " + - * =",
    ]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    rows = decontaminate.matches(frame, spark.createDataFrame(items, "item_id long, text string")).filter("contaminated").collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(0, 1), (2, 2), (4, 3), (6, 4), (8, 5), (10, 6), (12, 8), (15, 5)}


def test_decontamination_without_literal_tokens(spark):
    number = "Compute 12 + 7 - 3 * 4 / 2"
    assert contaminated(spark, number, [f"the quiz says: {number}, and so on", "the quiz says: compute 13 + 8 - 4 * 5 / 3"]) == {0}
    names = "Alice Bob Carol Dave Erin Frank Grace Heidi Ivan Judy"
    assert contaminated(spark, names, [f"we met {names} there", "we met Anna Ben Cleo Dan Emma Finn Gina Hugo Ines Jack there"]) == {0}


def test_decontamination_reparameterised(spark):
    """Signs, decimals, number words, names in capitals or after a line break, units; one value for two slots is no match."""
    item = "The probe of NASA weighs 1.5 tons at -5 degrees and carries three cameras built by Siemens for the long way to Mars"
    docs = [
        item.replace("NASA", "ESA").replace("1.5", "2.25").replace("-5", "-40").replace("three", "12").replace("Siemens", "Bosch").replace("Mars", "Venus"),
        "so: " + item.replace("by Siemens", "by\nBosch").replace("of NASA", "of\tJaxa"),
        item.replace("Siemens", "NASA"),
        "The probe of ice weighs more at noon and carries cameras built by hand for the long way to town",
    ]
    assert contaminated(spark, item, docs) == {0, 1, 2}
    rows = decontaminate.matches(spark.createDataFrame([(0, docs[0]), (2, docs[2])], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r["doc_id"]: r["n_slots"] > 0 and r["consistent"] for r in rows}[0]


def test_decontamination_long_text(spark):
    item = "they all went down to the old mill and counted 7 white birds on the roof there"
    long = " ".join(f"word{k}" for k in range(40_000))
    assert contaminated(spark, item, [long, f"{long} {item.replace('7', '9')} {long}"]) == {1}


def test_decontamination_first_words(spark):
    capital = "What is the capital of France"
    assert contaminated(spark, capital, ["and the quiz asks What is the capital of France", "what is the capital of france", "What is the price of France"]) == {0, 1}
    assert contaminated(spark, "Tom has 5 apples and eats 2", ["Anna has 9 apples and eats 4", "so then Anna has 9 apples and eats 4", "Anna has 9 apples and eats 9", "she has 9 apples and eats 4"]) == {0, 1}
    assert contaminated(spark, "what is the age of Tom now", ["it asks What is the age of Anna now", "it says Nobody is the age of Anna now"]) == {0}
    # read as names, the two first words would both be Nobody
    item = "Than the train of red wood goes on to the sea by 9 in the day. Then it is there and all go home at last"
    assert contaminated(spark, item, item.replace("9", "7").replace("Than", "Nobody").replace("Then", "Nobody")) == {0}


def test_kd_shards(spark, nothing):
    rng = random.Random(1)
    rows = [(rng.randrange(10**6), "w" * rng.randrange(1, 300), "hot" if k % 3 == 0 else f"s{k % 9}", "en") for k in range(6000)]
    rows += [(5, "same text", "hot", "en")] * 900 + [(None, None, None, None)] * 40 + [(6, "", "hot", "de")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("shard", F.lit("clash")).withColumn("row", F.lit(0))
    got = kd_shards.shards(docs, n_shards=13).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean = sum(sizes.values()) / 13
    assert set(sizes) == set(range(13)) and all(abs(x - mean) < 2 * 316 for x in sizes.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert kd_shards.shards(nothing, n_shards=4).count() == 0
    assert len({r["shard"] for r in kd_shards.shards(docs, target_bytes=200_000).collect()}) == -(-sum(sizes.values()) // 200_000)


def formatted_plainly(chosen, rejected):
    k = 0
    while k < min(len(chosen), len(rejected)) and chosen[k] == rejected[k]:
        k += 1
    text = lambda turns: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)
    return text(chosen[:k]), text(chosen[k:]), text(rejected[k:])


def test_preferences(spark):
    convs = {
        0: [("user", "hi"), ("assistant", "yes"), ("user", "more"), ("assistant", "well")],
        1: [("user", "hi"), ("assistant", "yes"), ("user", "more"), ("assistant", "no")],
        2: [("user", "a")], 3: [("user", "b"), ("assistant", "c")],
        4: [("user", "same")], 5: [("user", "same")],
        6: [("user", "alone")],
        8: [("user", "x"), ("assistant", "y")], 9: [("user", "x")],
    }
    rows = [(c, k, r, t, "z") for c, turns in convs.items() for k, (r, t) in enumerate(turns)] + [(None, 0, "user", "q", "z"), (10, None, None, None, "z"), (10, 0, "user", "", "z"), (11, 0, "user", "x" * 50_000, "z"), (11, 0, "user", "x" * 50_000, "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")
    got = {r["pair_id"]: r for r in preferences.formatted(turns, preferences.adjacent_pairs(turns)).collect()}
    assert set(got) == {0, 1, 2, 4, 5}
    for pair in (0, 1, 2, 4):
        assert (got[pair]["prompt"], got[pair]["chosen"], got[pair]["rejected"]) == formatted_plainly(convs[pair * 2], convs[pair * 2 + 1])
    import json

    for side in ("chosen", "rejected"):
        (run,) = json.loads(got[0][f"{side}_mask"])
        assert got[0][side][run["start"] : run["end"]] == f"{convs[side == 'rejected'][3][1]}<|end|>\n"
    assert got[5]["chosen"] == "<|unknown|>\n<|end|>\n<|user|>\n<|end|>\n" and got[5]["prompt"] == ""
    assert preferences.formatted(turns.limit(0), preferences.adjacent_pairs(turns.limit(0))).count() == 0
