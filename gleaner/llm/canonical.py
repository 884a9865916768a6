"""Mapping freely typed values to a canonical list (problem 6) with a BK-tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.llm.text import INVISIBLE, edits, fold
from gleaner.operators.skew import keyed_join
from gleaner.session import wide
from gleaner.sources.tables import table

_CAMEL, _WORDS = re.compile(r"(?<=[a-z])(?=[A-Z])"), re.compile(r"[^\W_]+")
_NOISE = re.compile(r"^\s*\d+\s*[.):]?(?:\s+|_)|[(\[][^()\[\]]*[)\]][\s.]*$|#\s*\d+\s*$")
_VOWELS = str.maketrans("", "", "aeiou")
#: Forms of classes in one set of trees; a longer list goes to several, each broadcast by itself.
SHARD_FORMS = 200_000


@dataclass(frozen=True)
class Habits:
    """How people write around a name: a parameter, empty by default; the match itself needs none of it.

    placeholders and numbered: values that only hold a place; remarks: endings
    about one exemplar; qualifiers and articles: words before the name; codes:
    values whose digits count; alike: characters typed for letters.
    """

    placeholders: frozenset[str] = frozenset()
    numbered: str = r"(?!)"
    remarks: str = r"(?!)"
    qualifiers: frozenset[str] = frozenset()
    articles: frozenset[str] = frozenset()
    codes: str = r"(?!)"
    alike: tuple[tuple[str, str], ...] = ()

    @cached_property
    def table(self) -> dict[int, str]:
        return str.maketrans(dict(self.alike))

    def is_code(self, bare: str) -> bool:
        return re.match(self.codes, bare) is not None


#: What annotators of this project's tables do.
ANNOTATORS = Habits(
    frozenset(
        "todo tbd tba tmp temp test untitled unnamed unknown misc other none null nan na newclass newlabel noname "
        "donotuse notsure needsasecondlook duplicateofabove seeabove xxx asdf foo".split()
    ),
    r"^(?:new)?(?:class|label|category|item|object)\d*$",
    r"(?i)\s+[/-]\s+(?:occluded|partial|damaged|blurred|cropped|left|right|check)[\s.]*$",
    frozenset("broken small old new big large damaged dirty used".split()),
    frozenset("a an the".split()),
    r"^[a-z]{2,4}\d{3}[a-z]\d{3}$",
    tuple(zip("013457@$", "oleastas")),
)


def letters_of(value: str, habits: Habits = ANNOTATORS) -> list[str]:
    """Words of a value, folded, with leading numbers, counters and articles removed and look-alike digits read as letters."""
    value = re.sub(habits.remarks, " ", _CAMEL.sub(" ", value))
    value = _NOISE.sub(" ", _NOISE.sub(" ", value))
    signs = "".join(a for a, _ in habits.alike if not a.isalnum())
    pattern = re.compile(rf"[^\W_{re.escape(signs)}]*[{re.escape(signs)}][^\W_]*|[^\W_]+") if signs and any(c in value for c in signs) else _WORDS
    out = []
    for w in pattern.findall(fold(value)):
        if any(c.isalpha() for c in w) and not w.isalpha():
            w = w.translate(habits.table)
        out.append(w)
    out = [w for w in out if w not in habits.articles] or out
    while len(out) > 1 and out[0] in habits.qualifiers:
        out = out[1:]
    return out


def sound(key: str) -> str:
    """The key with spellings of one sound made alike and doubled letters single."""
    for a, b in (("ph", "f"), ("ck", "k"), ("oo", "u")):
        key = key.replace(a, b)
    return re.sub(r"(.)\1", r"\1", key)


def key_of(value: str, habits: Habits = ANNOTATORS) -> str:
    """The value's words without blanks; a code keeps its digits."""
    bare = "".join(_WORDS.findall(fold(value)))
    return bare if habits.is_code(bare) else "".join(letters_of(value, habits))


def is_blank(value: str | None) -> bool:
    return value is None or not INVISIBLE.sub("", value).strip()


def is_placeholder(value: str | None, habits: Habits = ANNOTATORS) -> bool:
    """True for null, blank, signs only, and names that only hold a place."""
    if is_blank(value):
        return True
    bare = "".join(_WORDS.findall(fold(value)))
    if not bare or bare in habits.placeholders or re.match(habits.numbered, bare):
        return True
    bare = "".join(letters_of(value, habits))
    return bare in habits.placeholders or any(len(p) > 6 and abs(len(p) - len(bare)) <= 2 and edits(bare, p) <= 2 for p in habits.placeholders)


def readings(value: str, habits: Habits = ANNOTATORS) -> list[str]:
    """Keys under which a value may stand in the list: as typed, with `B of A` turned to A B, and turned word orders."""
    bare = "".join(_WORDS.findall(fold(value)))
    if habits.is_code(bare):
        return [bare]
    w = letters_of(value, habits)
    out = ["".join(w)]
    if "of" in w[1:-1]:
        at = w.index("of", 1)
        out.append("".join(w[at + 1 :] + w[:at]))
        w = w[at + 1 :] + w[:at]
    out += ["".join(w[k:] + w[:k]) for k in range(1, len(w))]
    return list(dict.fromkeys(out))


def allowance(key: str, habits: Habits = ANNOTATORS) -> int:
    """Edits that a key may differ by: none for codes and short keys, one up to 7 letters, two beyond."""
    return 0 if len(key) < 5 or habits.is_code(key) else 1 if len(key) < 8 else 2


def distance(a: str, b: str) -> int:
    """Levenshtein distance, a metric, by bit vectors."""
    if not a or not b:
        return len(a) or len(b)
    m, peq = len(a), {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, d = mask, 0, m
    for c in b:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        d += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 | 1, mh << 1
        pv, mv = (mh | ~(xv | ph)) & mask, ph & xv & mask
    return d


class BKTree:
    """Entries by distance from their parent; a search skips children that the triangle inequality excludes."""

    def __init__(self, keys: list[str]):
        self.root: tuple[str, dict] | None = None
        for k in keys:
            self.add(k)

    def add(self, key: str) -> None:
        if self.root is None:
            self.root = (key, {})
            return
        node = self.root
        while (d := distance(node[0], key)) and d in node[1]:
            node = node[1][d]
        if d:
            node[1][d] = (key, {})

    def within(self, key: str, radius: int) -> list[tuple[int, str]]:
        """Every entry at most `radius` from key, nearest first."""
        found, stack = [], [self.root] if self.root else []
        while stack:
            entry, children = stack.pop()
            d = distance(entry, key)
            if d <= radius:
                found.append((d, entry))
            stack += [node for edge, node in children.items() if d - radius <= edge <= d + radius]
        return sorted(found)


def bag(key: str) -> np.ndarray:
    """Counts of the key's letters, all other characters as one."""
    codes = np.frombuffer(key.encode("utf-32-le"), np.uint32).astype(np.int64) - 97
    return np.bincount(np.where((codes < 0) | (codes > 25), 26, codes), minlength=27).astype(np.int16)


#: What a value finds in a list: how (0 as written, 1 by sound, 2 with slips), edits, rank, and the classes that tie.
Hit = tuple[int, int, int, tuple[str, ...]]


class Matcher:
    """Finds the classes of a value; forms maps a key to {class id: rank}, smaller ranks first.

    The full forms (rank 0 to 2) stand in one BK-tree per key length; shortened
    and sounded forms (rank 3) only match exactly. A tree is walked unless the
    letters of its keys, in any order, are all further from the value's than the
    edits allowed.
    """

    def __init__(self, forms: dict[str, dict[str, int]], habits: Habits = ANNOTATORS):
        self.forms, self.habits, self.trees, self.bags, self.seen, by_length = forms, habits, {}, {}, {}, {}
        for key in sorted(k for k, at in forms.items() if min(at.values()) < 3):
            by_length.setdefault(len(key), []).append(key)
        for n, keys in by_length.items():
            self.trees[n] = BKTree(keys)
            self.bags[n] = np.stack([bag(k) for k in keys])

    def _slips(self, key: str) -> list[tuple[int, str]]:
        """(edits, form) of the forms within the key's allowance."""
        most = allowance(key, self.habits)
        letters, out = bag(key) if most else None, []
        for n in range(len(key) - most, len(key) + most + 1) if most else ():
            if n not in self.trees:
                continue
            off = self.bags[n] - letters
            if (np.maximum(np.maximum(off, 0).sum(1), np.maximum(-off, 0).sum(1)) <= most).any():
                # two swaps of neighbours are four single edits
                near = self.trees[n].within(key, 2 * most)
                out += [(d, k) for _, k in near if (d := edits(key, k)) <= min(most, allowance(k, self.habits))]
        return out

    def hit(self, value: str) -> Hit | None:
        keys, how = readings(value, self.habits), 0
        found = [(0, k) for k in keys if k in self.forms]
        if not found:
            how, found = 1, [(0, s) for k in keys if (s := "~" + sound(k)) in self.forms]
        if not found:
            how = 2
            for key in keys:
                if key not in self.seen:
                    self.seen[key] = self._slips(key)
                found += self.seen[key]
            if len(self.seen) > 200_000:
                self.seen.clear()
        if not found:
            return None
        best = min(d for d, _ in found)
        ranked = [(rank, c) for d, k in found if d == best for c, rank in self.forms[k].items()]
        low = min(r for r, _ in ranked)
        return how, best, low, tuple(sorted({c for r, c in ranked if r == low}))

    def match(self, value: str) -> str:
        """The one class of the nearest forms; '' if there is none or they disagree."""
        hit = self.hit(value)
        return hit[3][0] if hit and len(hit[3]) == 1 else ""


def reference_forms(classes: list[dict], concepts: list[dict], habits: Habits = ANNOTATORS) -> dict[str, dict[str, int]]:
    """key -> {class id: rank} of all ways to write each class.

    Rank 0: name, 1: alias, 2: either with the concept's name replaced by a
    concept alias, 3: by sound (marked ~) or with one word shortened (vowels dropped, or cut after
    three letters or more, as abbreviations are).
    """
    forms: dict[str, dict[str, int]] = {}

    def put(key: str, cid: str, rank: int) -> None:
        if key:
            at = forms.setdefault(key, {})
            at[cid] = min(rank, at.get(cid, 9))

    by_id = {c["concept_id"]: c for c in concepts}
    for c in classes:
        if is_blank(c["class_id"]):
            continue
        base = [(v, min(r, 1)) for r, v in enumerate([c["name"], *(c["aliases"] or [])]) if not is_blank(v)]
        concept = by_id.get(c["concept"])
        if concept and concept["name"]:
            head, others = letters_of(concept["name"], habits), [a for a in concept["aliases"] or [] if not is_blank(a)]
            for v, _ in list(base):
                w = letters_of(v, habits)
                if w[: len(head)] == head:
                    base += [(" ".join([*letters_of(a, habits), *w[len(head) :]]), 2) for a in others]
        for v, rank in base:
            put(key_of(v, habits), c["class_id"], rank)
            put("~" + sound(key_of(v, habits)), c["class_id"], 3)
            if habits.is_code(key_of(v, habits)):
                continue
            w = letters_of(v, habits)
            for k, word in enumerate(w):
                short = {word[0] + word[1:].translate(_VOWELS)} | ({word[:n] for n in range(3, len(word))} if len(w) > 1 else set())
                for s in short:
                    if len(s) >= 3 and s != word:
                        put("".join([*w[:k], s, *w[k + 1 :]]), c["class_id"], 3)
            bare = [word[0] + word[1:].translate(_VOWELS) for word in w]
            put("".join(bare), c["class_id"], 3)
    return forms


def _shards(classes: DataFrame, concepts: DataFrame, habits: Habits) -> Iterator[dict[str, dict[str, int]]]:
    """The forms of all classes, in as many parts as SHARD_FORMS asks for (about 40 forms a name or alias); each is collected by itself."""
    names = classes.agg(F.sum(1 + F.coalesce(F.size("aliases"), F.lit(0)))).first()[0] or 0
    n = max(1, -(-40 * names // SHARD_FORMS))
    for k in range(n):
        part = classes.select("class_id", "name", "concept", "aliases")
        part = part if n == 1 else part.filter(F.pmod(F.xxhash64("class_id"), F.lit(n)) == k)
        named = concepts.select("concept_id", "name", "aliases").join(part.select(F.col("concept").alias("concept_id")).distinct(), "concept_id", "left_semi")
        cl, co = ([r.asDict(recursive=True) for r in df.collect()] for df in (part, named))
        yield reference_forms(cl, co, habits)


def map_values(entries: DataFrame, classes: DataFrame, concepts: DataFrame, habits: Habits = ANNOTATORS) -> DataFrame:
    """(entry_id, class_id) of entries(entry_id, name, aliases) that aren't verbatim a class name and not wholly blank.

    The name is tried first; a placeholder, blank or null name defers to the
    aliases in their order. class_id is '' where nothing fits within the allowed
    edits or the nearest fits disagree. Null and blank aliases are skipped;
    repeated entries give repeated rows. Distinct values are matched once, with
    every shard of the list, and the shards' winners are merged.
    """
    spark = entries.sparkSession

    def pass_(pairs: DataFrame, forms: dict[str, dict[str, int]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(forms)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = Matcher(shared.value, habits)
            for pdf in frames:
                out = []
                for key, name, aliases in zip(pdf["key"], pdf["name"], pdf["aliases"]):
                    aliases = [a for a in (aliases if aliases is not None else []) if not is_blank(a)]
                    values = [a for a in aliases if not is_placeholder(a, habits)] if is_placeholder(name, habits) else [name]
                    out += [(key, at, *hit[:3], list(hit[3])) for at, v in enumerate(values) if (hit := matcher.hit(v))]
                yield pd.DataFrame(out, columns=["key", "at", "how", "edits", "rank", "classes"])

        return pairs.mapInPandas(run, "key string, at int, how int, edits int, rank int, classes array<string>")

    blank = lambda c: F.trim(F.regexp_replace(c, r"[\s ​‌‍﻿]", "")) == ""
    some = F.coalesce(~blank(F.col("name")), F.lit(False)) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.coalesce(~blank(a), F.lit(False)))
    verbatim = classes.select("name").filter("name is not null").distinct()
    wanted = entries.select("entry_id", "name", "aliases").filter(some).join(verbatim, "name", "left_anti")
    wanted = wanted.withColumn("key", F.to_json(F.struct("name", "aliases")))
    pairs = wanted.groupBy("key").agg(F.first("name").alias("name"), F.first("aliases").alias("aliases")).repartition(wide(spark))
    hits: DataFrame | None = None
    for forms in _shards(classes, concepts, habits):
        part = pass_(pairs, forms)
        hits = part if hits is None else hits.unionByName(part)
    place = F.struct("how", "edits", "rank")
    best = hits.groupBy("key", "at").agg(F.min(place).alias("best"), F.collect_list(F.struct(place.alias("place"), "classes")).alias("all"))
    ties = F.array_distinct(F.flatten(F.transform(F.filter("all", lambda h: h["place"] == F.col("best")), lambda h: h["classes"])))
    found = best.select("key", "at", ties.alias("ties")).filter("size(ties) = 1").groupBy("key").agg(F.min_by(F.col("ties")[0], "at").alias("class_id"))
    return keyed_join(wanted.select("entry_id", "key"), found, "key", "left").select("entry_id", F.coalesce("class_id", F.lit("")).alias("class_id"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return map_values(table(spark, root, "class_entries"), table(spark, root, "classes"), table(spark, root, "concepts"))
