"""Text cut off by field limits (problem 10) by a backward character n-gram model."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.operators.skew import keyed_join
from gleaner.session import drop_scratch, materialize, spread
from gleaner.sources.tables import table

#: Lengths of the contexts that end a text, shortest first.
ORDERS = (1, 2, 3, 5, 8, 12, 17, 24)
#: Weight of a shorter context's estimate, in occurrences, and the log-odds below which an end is a cut, where nothing else is known.
PRIOR, CUT = 2.0, -3.0
#: Contexts at more ends than this, and than a HOT_SHARE-th of all, are joined by broadcast.
HOT_ENDS, HOT_SHARE = 10_000, 2_000
#: Bits of the filter for each context that it holds; it grows with them up to MAX_FILTER_BITS (16 MB).
BITS_EACH, MAX_FILTER_BITS = 16, 1 << 27
#: Thresholds to choose from, half the width of the valley around one, and the weight of the pooled
#: distribution, in documents, against that of a language and source.
CUTS, VALLEY, POOLED = tuple(x / 4 for x in range(-18, -5)), 0.5, 500.0
#: Longest closing words, in characters.
CLOSING = 24
_SENTENCES = re.compile(r"[.!?][\"'”’»)]*\s+")
_B = 0x9E3779B97F4A7C15 | 1
_BINV = pow(_B, -1, 1 << 64)
#: Marks that stand where a text was cut.
_MARK = re.compile(r"(?:\s*(?:\.{2,}|…|[\[({<]\s*(?:\.{2,}|…|truncated|cut|more|continued|continues|snip|clipped|shortened)[^\])}>\n]{0,20}[\])}>]|-->|>>+|(?<=[^\W\d_])[-\u2010\u2011]|\ufffd|\bread more\b|\(cont\.?\)))+\s*$", re.I)
_BROKEN, _TAGS = re.compile(r"(?<=[^\W\d_])-[^\S\n]*\n\s*(?=[^\W\d_])"), re.compile(r"</?[A-Za-z][^<>\n]*>")
_DIGITS, _BLANKS = re.compile(r"\d+"), re.compile(r"[^\S\n]+")
_LOW_QUOTES = re.compile(r"„([^“”\n]*)[“”]")
_OPEN, _CLOSE = "([{“«", ")]}”»"


def plain(text: str) -> str:
    """Lower-case text with numbers as 0, single blanks, and lines without their trailing blanks and cut marks."""
    text = _BROKEN.sub("", _TAGS.sub("", text))
    lines = (_MARK.sub("", _BLANKS.sub(" ", line)).rstrip() for line in _DIGITS.sub("0", text.lower()).split("\n"))
    return _LOW_QUOTES.sub(r"“\1”", "\n".join(line for line in lines if line))


def settles(text: str) -> bool:
    """True if a final end like this one may stand for ends at large.

    The last line is no prose, or it ends on a sign, or what follows its last
    sentence is short, as in closing words. A text that stops within a long
    sentence says nothing about where texts end.
    """
    line = text.rsplit("\n", 1)[-1]
    return shape_of(line) > 0 or not line[-1].isalnum() or len(_SENTENCES.split(line)[-1]) <= CLOSING


def shape_of(line: str) -> int:
    """What kind of line this is, from its start: prose, list or table, label, link, log."""
    if not line or line[0].isalpha():
        if line.startswith(("http:", "https:", "www.")):
            return 3
        return 2 if re.match(r"[a-z][\w -]{1,14}:(?: |$)", line) else 0
    return 4 if line[0] == "0" else 5 + "-|*[>#+".find(line[0])


class Codes:
    """Hashes of all contexts of a batch of texts, each text with a line break before and after."""

    def __init__(self, texts: list[str]):
        joined = "\n" + "\n\n".join(texts) + "\n"
        c = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
        n = len(c)
        at = np.arange(n)
        self.breaks = c == 10
        start = np.maximum.accumulate(np.where(self.breaks, at, 0))
        self.depth_in_line = at - start
        kinds = np.zeros(n, np.int64)
        kinds[self.breaks] = [shape_of(line) for line in joined.split("\n")[1:]]
        self.kind = kinds[start]
        opens, closes = (np.isin(c, [ord(x) for x in s]).astype(np.int64) for s in (_OPEN, _CLOSE))
        tag = (c[:-1] == 60) & ((c[1:] == 47) | ((c[1:] >= 97) & (c[1:] <= 122)))
        opens[:-1] += tag
        closes += (c == 62) & np.r_[False, np.maximum.accumulate(np.r_[np.where(tag, at[:-1], -1), -1])[:-1] >= start[1:]]
        level = np.cumsum(opens - closes)
        self.inside = np.clip(level - level[start], 0, 1)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(n + 1, _B, np.uint64)) * np.uint64(_BINV)
            self.inverse = np.cumprod(np.full(n + 1, _BINV, np.uint64)) * np.uint64(_B)
            self.sums = np.r_[np.uint64(0), np.cumsum((c + np.uint64(7)) * power[:n])]
        self.state = (self.kind * 2 + self.inside).astype(np.uint64)
        self.chars, self.n = c, n

    def at(self, where: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the contexts of `order` characters that end at the places and stay in their line (with its break)."""
        ok = where[self.depth_in_line[where] >= order - 1] if order else where
        with np.errstate(over="ignore"):
            h = (self.sums[ok + 1] - self.sums[ok + 1 - order]) * self.inverse[ok + 1 - order]
            h = (h ^ (self.state[ok] + np.uint64(1 + 64 * order)) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD)
        return ok, (h ^ (h >> np.uint64(32))).view(np.int64)

    def finals(self) -> np.ndarray:
        """The last character of each text."""
        pair = np.flatnonzero(self.breaks[:-1] & self.breaks[1:])
        return np.r_[pair, self.n - 1] - 1

    def ends(self) -> np.ndarray:
        """True at the last character of a line or, outside brackets, of a sentence that a blank follows."""
        c = self.chars
        stop = np.isin(c, [ord(x) for x in ".!?"]) | (np.isin(c, [ord(x) for x in _CLOSE + "\"'’"]) & np.r_[False, np.isin(c[:-1], [ord(x) for x in ".!?"])])
        blank = np.r_[c[1:] == 32, False]
        return np.r_[self.breaks[1:], True] | (stop & blank & (self.inside == 0))


def _chunks(texts: list[str], most: int = 300_000) -> Iterator[Codes]:
    """Codes of the texts, some at a time, to bound memory; a longer text is a chunk of its own."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield Codes(part)
            part, size = [], 0
        part.append(t)
        size += len(t) + 2
    if part:
        yield Codes(part)


def tails(texts: DataFrame) -> DataFrame:
    """(copy, level, context, settled) of the end of each of texts(copy, text), one row per level; level 0 is the line's state alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            plains = [plain(t) for t in pdf["text"]]
            keep = [i for i, t in enumerate(plains) if t]
            copies, done = pdf["copy"].to_numpy()[keep], 0
            settled = np.array([settles(plains[i]) for i in keep], dtype=bool)
            for codes in _chunks([plains[i] for i in keep]):
                last = codes.finals()
                row_of = np.full(codes.n, -1)
                row_of[last] = np.arange(done, done + len(last))
                done += len(last)
                for level, order in enumerate((0, *ORDERS)):
                    where, hashes = codes.at(last, order)
                    yield pd.DataFrame({"copy": copies[row_of[where]], "level": level, "context": hashes, "settled": settled[row_of[where]]})

    return spread(texts).mapInPandas(run, "copy long, level int, context long, settled boolean")


def _filter(ends: DataFrame) -> np.ndarray:
    """Bits, BITS_EACH for each distinct context of the tails, with its own set; at most MAX_FILTER_BITS.

    It only spares work: contexts that pass it by chance are counted in vain.
    """
    distinct = ends.agg(F.approx_count_distinct("context")).first()[0]
    size = min(MAX_FILTER_BITS, 1 << max(16, int(BITS_EACH * distinct).bit_length()))
    bits = ends.select(F.pmod("context", F.lit(size)).alias("bit"))
    words = bits.select(F.expr("int(bit div 32)").alias("word"), F.expr("shiftleft(1L, int(bit % 32))").alias("bits"))
    got = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most MAX_FILTER_BITS / 32 rows
    out = np.zeros(size // 32, np.uint32)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)
    return out


def count_contexts(texts: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(context, n_end, n_go): how often each wanted context, inside a text, ends a line or sentence, and how often it goes on."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def total(parts: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(parts)
        keys, back = np.unique(rows[:, 0], return_inverse=True)
        sums = np.zeros((len(keys), 2), np.int64)
        np.add.at(sums, back, rows[:, 1:])
        return np.column_stack([keys, sums])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, parts, held = shared.value, [], 0
        size = len(bits) * 32
        show = lambda t: pd.DataFrame({"context": t[:, 0], "n_end": t[:, 1], "n_go": t[:, 2]})
        for pdf in frames:
            for codes in _chunks([p for t in pdf["text"] if (p := plain(t))]):
                end = codes.ends()
                inner = ~codes.breaks
                inner[codes.finals()] = False
                for order in (0, *ORDERS):
                    where, hashes = codes.at(np.flatnonzero(inner), order)
                    low = hashes % size
                    hit = (bits[low >> 5] >> (low & 31).astype(np.uint32)) & 1 == 1
                    keys, back = np.unique(hashes[hit], return_inverse=True)
                    stop = end[where[hit]]
                    parts.append(np.column_stack([keys, np.bincount(back[stop], minlength=len(keys)), np.bincount(back[~stop], minlength=len(keys))]))
                    held += len(keys)
                if held > 2_000_000:
                    parts = [total(parts)]
                    if len(parts[0]) > 1_000_000:
                        yield show(parts[0])
                        parts = []
                    held = sum(map(len, parts))
        if parts:
            yield show(total(parts))

    partial = spread(texts).mapInPandas(run, "context long, n_end long, n_go long")
    return partial.groupBy("context").agg(F.sum("n_end").alias("n_end"), F.sum("n_go").alias("n_go"))


def end_odds(documents: DataFrame) -> DataFrame:
    """(copy, log_odds) of each distinct text that isn't blank: ln P(it ends here) / P(it goes on).

    The model reads backwards from the end: contexts of growing length, each
    blended with the shorter one's estimate as PRIOR occurrences. A text's own
    end is left out of its counts, as are final ends within a long sentence, and
    copies of a text count as one.
    """
    copies = documents.filter("text is not null").groupBy(F.xxhash64("text").alias("copy"))
    texts = materialize(copies.agg(F.min("text").alias("text")), "texts")
    ends = materialize(tails(texts), "tails")
    inner = count_contexts(texts, _filter(ends))
    final = ends.groupBy("context").agg(F.count("*").alias("n_ends"), F.sum(F.col("settled").cast("long")).alias("n_final"))
    known = materialize(final.join(inner, "context", "left").na.fill(0), "contexts")
    rows = ends.count()
    hot = known.filter(F.col("n_ends") > max(HOT_ENDS, rows // HOT_SHARE))
    few = [r["context"] for r in hot.select("context").collect()]  # fewer than HOT_SHARE
    is_hot = F.col("context").isin(few) if few else F.lit(False)
    joined = ends.filter(~is_hot).join(known, "context").unionByName(ends.filter(is_hot).join(F.broadcast(hot), "context"))
    others = F.col("n_final") - F.col("settled").cast("long") + F.col("n_end")
    steps = F.array_sort(F.collect_list(F.struct("level", others.alias("e"), (others + F.col("n_go")).alias("n"))))
    p = F.aggregate(steps, F.lit(0.05), lambda p, s: (s["e"] + F.lit(PRIOR) * p) / (s["n"] + F.lit(PRIOR)))
    odds = joined.groupBy("copy").agg(p.alias("p")).select("copy", F.least(F.greatest("p", F.lit(1e-9)), F.lit(1 - 1e-9)).alias("p"))
    out = materialize(odds.select("copy", F.log(F.col("p") / (1 - F.col("p"))).alias("log_odds")), "odds")
    for part in (texts, ends, known):
        drop_scratch(texts.sparkSession, part)
    return out


def fit_cuts(odds: DataFrame) -> DataFrame:
    """(lang, source, cut_at) of odds(lang, source, log_odds), one row per document: each group's threshold.

    Whole ends and cuts are two hills of the distribution of log-odds; the
    threshold is the one of CUTS in the lowest valley between them, nearest to CUT
    among equals. A group counts with the pooled distribution as POOLED further
    documents, so a small or unmixed group keeps the common valley.
    """
    near = [F.count_if((F.col("log_odds") > t - VALLEY) & (F.col("log_odds") <= t + VALLEY)).cast("double") for t in CUTS]
    per = odds.filter("log_odds is not null").groupBy("lang", "source").agg(F.count("*").alias("n"), F.array(*near).alias("near"))
    pooled = per.select("n", F.posexplode("near").alias("k", "x")).groupBy("k").agg((F.sum("x") / F.sum("n")).alias("share"))
    pooled = pooled.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "share"))), lambda s: s["share"]).alias("pooled"))  # one row of len(CUTS) shares
    place = F.array(*[F.lit(t) for t in CUTS])
    valley = F.transform(F.arrays_zip("near", "pooled", place.alias("t")), lambda z: F.struct((z["near"] + POOLED * z["pooled"]).alias("x"), F.abs(z["t"] - CUT).alias("far"), z["t"].alias("t")))
    return per.crossJoin(F.broadcast(pooled)).select("lang", "source", F.array_min(valley)["t"].alias("cut_at"))


def truncated(documents: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """(doc_id, lang, source, log_odds, cut) of every document; cut tells that its end is lost.

    A text is cut when the log-odds of its end lie below the threshold of its
    language and source: that of `cuts` (lang, source, cut_at), else the one that
    fit_cuts finds. Trailing blanks and cut marks are set aside first, so a mark
    alone decides nothing. Null and blank texts have null log_odds and aren't
    cut; a null language is 'und', a null source ''. Repeated rows are judged alike.
    """
    odds = end_odds(documents)
    docs = documents.select("doc_id", F.coalesce(F.lower("lang"), F.lit("und")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.xxhash64("text").alias("copy"))
    judged = materialize(keyed_join(docs, odds, "copy", "left").select("doc_id", "lang", "source", "log_odds"), "judged")
    group = lambda d: d.withColumn("group", F.to_json(F.struct("lang", "source")))
    limits = group(fit_cuts(judged) if cuts is None else cuts).select("group", "cut_at")
    met = keyed_join(group(judged), limits, "group", "left")
    return met.select("doc_id", "lang", "source", "log_odds", F.coalesce(F.col("log_odds") < F.coalesce("cut_at", F.lit(CUT)), F.lit(False)).alias("cut"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return truncated(table(spark, root, "documents").select("doc_id", "text", "lang", "source")).filter("cut").select("doc_id").distinct()


def p10_sources(spark: SparkSession, root: str) -> DataFrame:
    """Each source's documents, cut documents and their rate."""
    judged = truncated(table(spark, root, "documents").select("doc_id", "text", "lang", "source"))
    return judged.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("cut").cast("long")).alias("n_cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("rate"))
