import random

import pytest
from hypothesis import given, settings, strategies as st

from gleaner.llm import canonical, leaks, mixing, truncation
from gleaner.llm.registry import QUERIES
from gleaner.llm.text import edits, located_words, words
from tests.conftest import DATA

letters = st.text("abc", max_size=8)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(letters, letters)
def test_distance_is_levenshtein(a, b):
    assert canonical.distance(a, b) == plain_distance(a, b)


@settings(max_examples=60, deadline=None)
@given(st.sets(letters, max_size=25), letters, st.integers(0, 4))
def test_tree_returns_every_entry_within(keys, key, radius):
    got = canonical.BKTree(sorted(keys)).within(key, radius)
    assert sorted(k for _, k in got) == sorted(k for k in keys if plain_distance(k, key) <= radius)


CLASSES = [
    {"class_id": "c1", "name": "garden hose faceplate", "concept": "k1", "aliases": ["garden hose front panel", "GAR-123A001", "", None]},
    {"class_id": "c2", "name": "garden hose handle", "concept": "k1", "aliases": None}, {"class_id": "c3", "name": "rain barrel spindle", "concept": "k2", "aliases": []},
]
CONCEPTS = [{"concept_id": "k1", "name": "garden hose", "aliases": ["sprinkling tube"]}, {"concept_id": "k2", "name": "rain barrel", "aliases": None}]


@pytest.mark.parametrize(
    ("value", "found"),
    [("garden hose faceplate", "c1"), ("Gardn hoes faceplate", "c1"), ("faceplate of the sprinkling tube", "c1"), ("handle, garden hose", "c2"), ("gаrdеn_hоsе fcplt", "c1"), ("g4rd3n h053 hand13", "c2"),
     ("gar 123a001.", "c1"), ("GAR-123A002", ""), ("wine barrel spindle", ""), ("garden hose", ""), ("broken garden hose handles - partial", "c2"), ("GardenHoseFacePlate", "c1"), ("ｇａｒｄｅｎ ｈｏｓｅ ｈａｎｄｌｅ (left)", "c2")],
)
def test_values_find_their_class(value, found):
    assert canonical.Matcher(canonical.reference_forms(CLASSES, CONCEPTS)).match(value) == found


def test_entries(spark):
    entries = [(1, "garden hose faceplate", []), (2, "todo", ["x", "gardn hose handle"]), (3, None, None), (4, " ", ["", None]), (5, None, ["rain barel spindle"]), (6, "lava lamp", ["garden hose handle"]), (7, "zzz" * 20_000, None), (2, "todo", ["x", "gardn hose handle"])]
    schema = "entry_id long, name string, aliases array<string>"
    cl = spark.createDataFrame([tuple(c.values()) for c in CLASSES], "class_id string, name string, concept string, aliases array<string>")
    co = spark.createDataFrame([tuple(c.values()) for c in CONCEPTS], "concept_id string, name string, aliases array<string>")
    got = sorted(tuple(r) for r in canonical.map_values(spark.createDataFrame(entries, schema), cl, co).collect())
    assert got == [(2, "c2"), (2, "c2"), (5, "c3"), (6, ""), (7, "")]
    assert canonical.map_values(spark.createDataFrame([], schema), cl, co).count() == 0


ITEM = "Which ferrule overlaps the hollow knapsack when the opaque filament hides a caster after a long pause on the second screen"


def brute(text, item, least):
    """The longest run of the item in the text, by trying all places: no two words in a row may be mistyped."""
    best = 0
    for shift in range(-len(text), len(item)):
        n = slipped = 0
        for k in range(max(0, -shift), min(len(text), len(item) - shift)):
            same = text[k] == item[k + shift]
            if same or (leaks.mistyped(text[k], item[k + shift]) and not slipped):
                n += 1
            else:
                # a run may begin with the slip itself
                n = 1 if leaks.mistyped(text[k], item[k + shift]) else 0
            slipped = n > 0 and not same
            best = max(best, n)
    return best if best >= least else 0


@pytest.mark.parametrize(
    ("text", "n"),
    [(ITEM, 21), (ITEM.upper().replace(" ", " -- "), 21), (ITEM.replace("hollow", "hollwo").replace("opaque", "opqaue"), 21), (ITEM.replace("hollow", "**hol**low<b>").replace("a", "а"), 21),
     (ITEM.replace("knapsack", "knap-\n> sack"), 21), (ITEM.replace("opaque", "xyzzyqq"), 12), (" ".join(ITEM.split()[3:12]), 9),
     (" ".join(w[:-1] + "q" if i % 2 else w for i, w in enumerate(ITEM.split())), 21), (" ".join(w + "x" if i % 3 == 0 else w for i, w in enumerate(ITEM.split())), 21)],
)
def test_runs_survive_disguise(text, n):
    item, w = words(ITEM), words(text)
    got = leaks.SuffixAutomaton([(1, item)]).passages(w, 1)
    assert got[1][1] == n == brute(w, item, 1)
    if n >= 14:
        assert leaks.Screen([(1, item)], 14).hold([["none"], w, []]).tolist() == [False, True, False]


WORDS = ["ab", "ac", "bd", "lamp", "lamps", "stone", "stoen", "x"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORDS), max_size=12), min_size=1, max_size=4), st.lists(st.sampled_from([*WORDS, "zzz", "lapm"]), max_size=15), st.integers(1, 6))
def test_automaton_and_screen_find_every_passage(items, text, least):
    known = list(enumerate(items))
    want = {k: n for k, item in known if (n := brute(text, item, least))}
    got = {k: n for k, (_, n) in leaks.SuffixAutomaton(known).passages(text, least).items()}
    assert got == want
    if want:
        assert leaks.Screen(known, least).hold([text]).all()


def test_passages_are_cut_out(spark):
    around = "before it " + "nothing in this sentence is known at all, not one bit of what comes here " * 4
    docs = spark.createDataFrame([(1, f"{around}&amp; <b>{ITEM.replace('hollow', 'hollwo')}</b>. After"), (2, ITEM), (3, "free"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(9, ITEM)], "item_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in leaks.without_leaks(docs, items).collect()}
    assert got == {1: (f"{around}&amp; <b></b>. After", 21), 2: (None, 21)}
    assert [w for w, *_ in located_words("Straße &amp; <b>hol</b>low\nknap-\nsack **a**b")] == words("Straße &amp; <b>hol</b>low\nknap-\nsack **a**b")


def test_items_in_several_shards(spark, monkeypatch):
    monkeypatch.setattr(leaks, "SHARD_CHARS", 60)
    many = [(i, ITEM.replace("ferrule", f"ferrule{'q' * i}")) for i in range(5)]
    docs, items = spark.createDataFrame([(i, t) for i, t in many], "doc_id long, text string"), spark.createDataFrame(many, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked_spans(docs, items).collect()}
    assert got == {(i, j) for i in range(5) for j in range(5)}
    assert leaks.leaked_spans(docs, items.limit(0)).count() == 0


def test_leaks_of_odd_documents(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 200_000 + ITEM), (3, ITEM), (4, "none")], "doc_id long, text string")
    items = spark.createDataFrame([(9, ITEM), (8, None), (7, "short")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaked_spans(docs, items).collect()} == {(3, 9)}
    assert leaks.leaked_spans(docs.limit(0), items).count() == 0


def test_mixing(spark):
    sized = spark.createDataFrame([(i, "big", "t", 10) for i in range(2000)] + [(5000, "small", "t", 100), (5001, None, "t", 50), (5002, "small", None, 0)], "doc_id long, source string, text string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.4, 3), ("none", 0.1, 1), (None, 0.1, 1), ("big", 0.5, 2)], "source string, target_share double, max_repeats int")
    rates = mixing.source_rates(sized, targets)
    r = {x["source"]: x for x in rates.collect()}
    assert len(r) == 3 and r["small"]["capped"] and r["small"]["rate"] == 3.0 and r["none"]["capped"] and not r["big"]["capped"]
    assert abs(r["big"]["rate"] - 0.5 * 20_150 / 20_000) < 1e-9
    n = {x["source"]: x["count"] for x in mixing.mix(sized, rates, "doc_id").groupBy("source").count().collect()}
    assert n["small"] == 6 and abs(n["big"] - 2000 * r["big"]["rate"]) < 120
    assert mixing.source_rates(sized.limit(0), targets).filter("capped").count() == 0
    assert [x["n_tokens"] for x in mixing.token_counts(spark.createDataFrame([(None,), ("",), ("one two",)], "text string")).collect()] == [0, 0, 2]


def test_cut_texts(spark):
    r = random.Random(1)
    ends = ["because the tray was overfull.", "until the lamp was replaced.", "and nobody objected to the change.", "which raised the accept rate."]
    starts = ["The reviewer moved 12 crops", "One annotator renamed the class", "The night shift counted 7 sessions", "The depot team left the old labels"]
    whole = [" ".join(f"{r.choice(starts)} {r.choice(ends)}" for _ in range(6)) + r.choice(["", "\n- item one", "\nStatus: open", " And so on …"]) for _ in range(400)]
    cut = [w[: len(w) // 2 - 3].rstrip(". ") + m for w, m in zip(whole[:12], ["", "...", " (truncated)", " \n"] * 3)]
    cut = [c for c in cut if not c.rstrip(" .…\n").removesuffix("(truncated)").rstrip().endswith(tuple(e[:-1] for e in ends))]
    rows = [(i, t, "en", "s") for i, t in enumerate(whole)] + [(1000 + i, t, None, None) for i, t in enumerate(cut)] + [(2000, None, "en", "s"), (2001, " \n", "en", "s"), (2002, "-", "en", "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x["doc_id"] for x in truncation.truncated(d).filter("cut").collect()}
    assert got >= {1000 + i for i in range(len(cut))} and len([x for x in got if x < 1000]) <= 4 and not got & {2000, 2001}
    assert truncation.truncated(d.limit(0)).count() == 0


def test_copies_of_a_text_count_once(spark):
    r = random.Random(3)
    pick = lambda *w: r.choice(w)
    rows = [(i, f"{pick('One', 'Some', 'Each')} {pick('crew', 'team', 'group')} {pick('moved', 'kept', 'sorted')} {r.randrange(9)} crops {pick('early', 'late', 'again')}.", "en", "s") for i in range(300)]
    rows.append((900, "They said so. The crew sorted the whole pile by hand", "en", "s"))
    copied = "On that day the crew sorted the whole pile by hand and nobody objected to it at all."
    once = spark.createDataFrame([*rows, (901, copied, "en", "s")], "doc_id long, text string, lang string, source string")
    often = once.unionByName(spark.range(5000).selectExpr("id + 1000 as doc_id", f"'{copied}' as text", "'en' as lang", "'s' as source"))
    odds = [{x["copy"]: round(x["log_odds"], 9) for x in truncation.end_odds(d).collect()} for d in (once, often)]
    assert odds[0] == odds[1]


@pytest.mark.parametrize("name", ["p6_found", "p8_found", "p8_items", "p8_removed", "p9_found", "p9_mix", "p9_shares", "p10_found", "p10_sources", "p5_subset", "p3_splits", "p2_clusters"])
def test_queries_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_edits_count_swaps_once():
    assert edits("abcd", "acbd") == 1 and edits("", "ab") == 2


def test_slips_in_turned_words_and_no_habits():
    m = canonical.Matcher(canonical.reference_forms(CLASSES, CONCEPTS))
    assert m.match("facplate garden hose") == "c1" and m.match("handle_of_the_gardn hose") == "c2"
    bare = canonical.Habits()
    m = canonical.Matcher(canonical.reference_forms(CLASSES, CONCEPTS, bare), bare)
    assert m.match("Gardn hoes faceplate") == "c1" and m.match("handle, garden hose") == "c2" and m.match("wine barrel spindle") == ""


def test_shards_of_the_list_agree_with_one(spark, monkeypatch):
    entries = spark.createDataFrame([(i, v, None) for i, v in enumerate(["gardn hose handle", "rain barel spindle", "garden hose faceplate!", "nothing", "garden hose hndl"])], "entry_id long, name string, aliases array<string>")
    cl = spark.createDataFrame([tuple(c.values()) for c in CLASSES], "class_id string, name string, concept string, aliases array<string>")
    co = spark.createDataFrame([tuple(c.values()) for c in CONCEPTS], "concept_id string, name string, aliases array<string>")
    one = sorted(tuple(r) for r in canonical.map_values(entries, cl, co).collect())
    monkeypatch.setattr(canonical, "SHARD_FORMS", 40)
    assert sorted(tuple(r) for r in canonical.map_values(entries, cl, co).collect()) == one == [(0, "c2"), (1, "c3"), (2, "c1"), (3, ""), (4, "c2")]


def test_thresholds_per_language_and_source(spark):
    rows = [("de", "a", -4.0 + 0.1 * (i % 9)) for i in range(4000)] + [("de", "a", 3.0)] * 100 + [("en", "b", -9.0), ("en", "b", None)] + [("en", "c", x) for x in (-8.0, 3.0) for _ in range(50)]
    got = {(r["lang"], r["source"]): r["cut_at"] for r in truncation.fit_cuts(spark.createDataFrame(rows, "lang string, source string, log_odds double")).collect()}
    assert got["de", "a"] == -2.5 and set(got) == {("de", "a"), ("en", "b"), ("en", "c")}
    d = spark.createDataFrame([(1, "One. Two. Thr", "xx", "s"), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    for at, cut in ((99.0, True), (-99.0, False)):
        limits = spark.createDataFrame([("xx", "s", at)], "lang string, source string, cut_at double")
        assert {r["doc_id"]: r["cut"] for r in truncation.truncated(d, limits).collect()} == {1: cut, 2: False}
