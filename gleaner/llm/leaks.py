"""Evaluation passages inside training text (problem 8) by a generalised suffix automaton."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.llm.text import edits, located_words, words
from gleaner.session import spread
from gleaner.sources.tables import table

MIN_WORDS = 14
#: Characters of items in one automaton; more items go to several, each broadcast by itself.
SHARD_CHARS = 1_500_000


def mistyped(a: str, b: str) -> bool:
    """True if a may be b with a slip of the keyboard: one edit, two in words of five letters or more."""
    n = max(len(a), len(b))
    return abs(len(a) - len(b)) <= 2 and edits(a, b) <= (2 if n >= 5 else 1)


class Spelling:
    """The words of a vocabulary that a word may be a slip for, by the strings both become with up to two letters left out."""

    def __init__(self, vocabulary: set[str]):
        self.at: dict[str, list[str]] = {}
        self.seen: dict[str, list[str]] = {}
        for w in vocabulary:
            for short in self._shorter(w):
                self.at.setdefault(short, []).append(w)

    @staticmethod
    def _shorter(w: str) -> set[str]:
        most = 2 if len(w) >= 3 and len(w) <= 40 else 1
        return {"".join(c for i, c in enumerate(w) if i not in out) for n in range(most + 1) for out in combinations(range(len(w)), n)} if len(w) <= 40 else {w}

    def near(self, word: str) -> list[str]:
        if word not in self.seen:
            found = {v for short in self._shorter(word) for v in self.at.get(short, ()) if v != word}
            self.seen[word] = sorted(v for v in found if mistyped(word, v))
        return self.seen[word]


class SuffixAutomaton:
    """All runs of words of several items; states are numbered, 0 is the empty run."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[int]] = [[]]
        for item, text in items:
            last = 0
            for word in text:
                last = self._extend(last, word)
                self.ends[last].append(item)
        self.spelling = Spelling({w for _, text in items for w in text})
        self.below: list[list[int]] = [[] for _ in self.link]
        for state in range(1, len(self.link)):
            self.below[self.link[state]].append(state)

    def _state(self, length: int, link: int, moves: dict[str, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: str) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, word: str) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def items_of(self, state: int) -> set[int]:
        """Items that hold the runs of a state: those that end in it or below it."""
        out, stack = set(), [state]
        while stack:
            s = stack.pop()
            out.update(self.ends[s])
            stack += self.below[s]
        return out

    def matches(self, text: list[str], least: int) -> Iterator[tuple[int, int, int]]:
        """(position, matching length, state) of every run of `least` words or more of an item that ends at a position of the text.

        The text streams through the automaton, which tracks the longest matching
        length of each state that a reading of the text leads to. A word that is
        no continuation may be a slip for one, unless the word before was a slip
        too, so lone mistyped words count, inside a run and at its ends.
        """
        step, link, longest, near = self.next, self.link, self.length, self.spelling.near
        active: dict[tuple[int, bool], int] = {}
        for at, word in enumerate(text):
            slips = near(word)
            after: dict[tuple[int, bool], int] = {}
            seen: dict[tuple[int, bool], int] = {}
            for (state, slipped), length in [*active.items(), ((0, False), 0)]:
                exact, wanted = True, slips if not slipped else ()
                while seen.get((state, slipped), -1) < length:
                    seen[state, slipped] = length
                    moves = step[state]
                    if exact and word in moves:
                        to = (moves[word], False)
                        after[to] = max(after.get(to, 0), length + 1)
                        exact = False
                    for v in wanted:
                        if v in moves:
                            to = (moves[v], True)
                            after[to] = max(after.get(to, 0), length + 1)
                    if not exact and not wanted:
                        break  # a shorter run could only read an ending of what this one reads
                    wanted = [v for v in wanted if v not in moves]
                    state = link[state]
                    if state <= 0:
                        break  # the root has its own turn
                    length = longest[state]
            active = {k: n for k, n in after.items() if not k[1] or after.get((k[0], False), 0) < n}
            for (state, _), n in active.items():
                # shorter endings of a run belong to further items
                while n >= least and state > 0:
                    yield at, n, state
                    state = link[state]
                    n = longest[state]

    def passages(self, text: list[str], least: int) -> dict[int, tuple[int, int]]:
        """item -> (first word, number of words) of its longest passage in the text; the first of equals."""
        best: dict[int, tuple[int, int]] = {}
        for at, n, state in self.matches(text, least):
            for item in self.items_of(state):
                best[item] = max(best.get(item, (0, 0)), (n, n - 1 - at))
        return {item: (-minus, n) for item, (n, minus) in best.items()}

    def covered(self, text: list[str], least: int) -> list[tuple[int, int]]:
        """(first, last + 1) word of the stretches that passages cover, apart and in order."""
        out: list[tuple[int, int]] = []
        for first, end in sorted({(at + 1 - n, at + 1) for at, n, _ in self.matches(text, least)}):
            if out and first <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], end))
            else:
                out.append((first, end))
        return out


class Screen:
    """Tells which texts may hold a passage, for whole batches at once; it never turns a text with one away.

    In a passage no two words in a row are mistyped, so its right words follow
    each other at distance one or two, and of `least` words half are right:
    least // 2 - 1 such pairs start within the passage.
    """

    def __init__(self, items: list[tuple[int, list[str]]], least: int):
        self.number = {w: i for i, w in enumerate(sorted({w for _, text in items for w in text}))}
        ids = [np.array([self.number[w] for w in text], np.int64) for _, text in items]
        size = len(self.number)
        self.pairs = [np.unique(np.concatenate([np.zeros(0, np.int64), *(x[:-d] * size + x[d:] for x in ids if len(x) > d)])) for d in (1, 2)]
        self.least, self.starts = least, least // 2 - 1

    def hold(self, texts: list[list[str]]) -> np.ndarray:
        if self.starts < 1:
            return np.ones(len(texts), bool)
        get, size, gap = self.number.get, len(self.number), [-1] * (self.least + 1)
        rows: list[int] = []
        first = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            first[i] = len(rows)
            rows += [get(w, -1) for w in text]
            rows += gap
        x = np.array(rows, np.int64)
        start = np.zeros(len(x), bool)
        for d, known in zip((1, 2), self.pairs):
            if len(known) and len(x) > d:
                key = x[:-d] * size + x[d:]
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                start[: len(key)] |= (known[at] == key) & (x[:-d] >= 0) & (x[d:] >= 0)
        total = np.r_[0, np.cumsum(start)]
        dense = start & (total[np.minimum(np.arange(len(x)) + self.least, len(x))] - total[:-1] >= self.starts)
        any_ = np.r_[0, np.cumsum(dense)]
        end = np.r_[first[1:], len(x)] if len(texts) else first
        return any_[end] > any_[first]


def _shards(items: DataFrame) -> Iterator[list[tuple[int, list[str]]]]:
    """The items' words, in as many parts as SHARD_CHARS asks for; each is collected by itself."""
    known = items.filter("text is not null").select("item_id", "text")
    n = max(1, -(-(known.agg(F.sum(F.length("text"))).first()[0] or 0) // SHARD_CHARS))
    for k in range(n):
        part = known if n == 1 else known.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield [(r["item_id"], words(r["text"])) for r in part.orderBy("item_id").collect()]


def _through(documents: DataFrame, items: DataFrame, least: int, read, schema: str) -> DataFrame:
    """Rows that read(automaton, items, doc_id, text, its words) gives for the documents that may hold a passage, over all shards of items."""
    rows = spread(documents.filter("text is not null").select("doc_id", "text"))

    def pass_(known: list[tuple[int, list[str]]]) -> DataFrame:
        shared = documents.sparkSession.sparkContext.broadcast(known)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton, screen, of = SuffixAutomaton(shared.value), Screen(shared.value, least), dict(shared.value)
            for pdf in frames:
                texts = [words(t) for t in pdf["text"]]
                hold = screen.hold(texts)
                out = [row for i in np.flatnonzero(hold).tolist() for row in read(automaton, of, pdf["doc_id"].iat[i], pdf["text"].iat[i], texts[i])]
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

        return rows.mapInPandas(run, schema)

    out: DataFrame | None = None
    for known in _shards(items):
        part = pass_(known)
        out = part if out is None else out.unionByName(part)
    return out


def leaked_spans(documents: DataFrame, items: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, coverage) of the longest passage of each item in each document.

    Texts compare by their words, folded for case, accents, look-alikes, markup
    and hyphens at line breaks. A passage is a run of `least` or more words of
    the item; single mistyped words count and don't break it. Null and empty
    texts hold nothing; repeated documents each report; an item of fewer words
    cannot leak. Each document streams through an automaton of the items
    (several, beyond SHARD_CHARS), built in every task from their broadcast words.
    """
    def read(automaton, of, doc, _, text):
        return [(doc, item, first, n, n / len(of[item])) for item, (first, n) in automaton.passages(text, least).items()]

    return _through(documents, items, least, read, "doc_id long, item_id long, first_word int, n_words int, coverage double")


def without_leaks(documents: DataFrame, items: DataFrame, least: int = MIN_WORDS, most_share: float = 0.5) -> DataFrame:
    """(doc_id, text, n_words, n_removed) of the documents with passages, which are cut out of the text.

    Passages of `least` words or more go, from the first to the last letter of
    their words. A document of which they cover more than `most_share` goes
    whole: its text is null. Other documents aren't listed. The shards' cuts are
    joined by document, so rows that repeat a doc_id need texts alike.
    """
    def read(automaton, of, doc, text, found):
        return [(doc, len(found), first, end) for first, end in automaton.covered(found, least)]

    cuts = _through(documents, items, least, read, "doc_id long, n_words long, first int, end int").distinct()
    spans = cuts.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_list(F.struct("first", "end"))).alias("spans"))
    once = documents.filter("text is not null").join(spans.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for doc, text, n, spans in zip(pdf["doc_id"], pdf["text"], pdf["n_words"], pdf["spans"]):
                apart: list[list[int]] = []
                for s in spans:
                    if apart and s["first"] <= apart[-1][1]:
                        apart[-1][1] = max(apart[-1][1], s["end"])
                    else:
                        apart.append([s["first"], s["end"]])
                gone = sum(b - a for a, b in apart)
                kept, last, places = [], 0, located_words(text)
                for a, b in apart:
                    kept.append(text[last : places[a][1]])
                    last = places[b - 1][2]
                rows.append((doc, None if gone > most_share * n else "".join([*kept, text[last:]]), n, gone))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "n_words", "n_removed"])

    return once.join(spans, "doc_id").mapInPandas(cut, "doc_id long, text string, n_words long, n_removed long")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return leaked_spans(table(spark, root, "documents"), table(spark, root, "eval_items")).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, root: str) -> DataFrame:
    """Every item that leaked, with its documents and its longest passage."""
    spans = leaked_spans(table(spark, root, "documents"), table(spark, root, "eval_items"))
    leaks = spans.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("n_words").alias("longest"), F.round(F.max("coverage"), 6).alias("coverage"))
    return table(spark, root, "eval_items").select("item_id", "suite").join(leaks, "item_id")


def p8_removed(spark: SparkSession, root: str) -> DataFrame:
    """The documents with leaked passages, without them."""
    return without_leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))
