"""Toxicity by a learned weighted lexicon.

Texts are folded (marks on letters and zero-width characters dropped, homoglyphs of other scripts and
digits and signs that stand for letters turned into these letters, lower case, words that are spelled
out with dots or dashes closed up) to a sequence of words with one blank between them.  Lexicon entries
are whole words or word beginnings with weights; exception phrases, in the same form, switch an entry
off where they cover it.  Both are matched by one Aho-Corasick pass, and the sum of weights is
normalised by length.

The lexicon is fitted on a bounded sample of labelled rows (``max_rows``, a documented parameter);
scoring covers every row and whole texts, in memory in proportion to a text's length.  Null texts count
as empty; an empty text scores like one without matches.  Without labels the lexicon is empty and every
score is the same low value.  Of labels that repeat an id the highest counts; repeated rows are scored
alike, and rows with an id of the sample are all in it; rows with a null id are scored, and aren't
learned from; which rows the sample takes of equals depends on a hash of the ids.  An empty table gives
an empty result.  Other columns are left alone; one named like the result is replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: Characters that are written in place of Latin letters.
LOOKALIKES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ӏ": "l",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
WORD = re.compile(r"[^\W_]+")


def _table() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for a, b in LOOKALIKES.items():
        for c in {a, a.upper()}:
            if len(c) == 1:
                table[ord(c)] = b
    table |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
    table |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370))}
    return table


FOLD = _table()
#: "!" closes a sentence more often than it stands for a letter: inside a word only.
BANG = re.compile(r"!(?=\w)(?<=\w!)")


#: Single letters with one sign between them are one word.
SPELLED = re.compile(r"(?<![^\W_])[^\W_](?:[.\-_*·][^\W_]){2,}(?![^\W_])")
SIGNS = re.compile(r"[.\-_*·]")


def fold(text: str) -> str:
    """The folded words of a text, a blank before, between and after them."""
    if not text.isascii():
        text = unicodedata.normalize("NFD", text)
    if "!" in text:
        text = BANG.sub("i", text).replace("!", " ")
    text = SPELLED.sub(lambda m: SIGNS.sub("", m[0]), text.translate(FOLD).lower())
    return " " + " ".join(WORD.findall(text)) + " "


def held_out(doc_id: str = "doc_id", folds: int = 5):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


#: Log odds that a word needs, letters that it has, and parts in which the threshold is tried on texts that the words weren't learned from.
LEAST_ODDS, LEAST_LETTERS, FOLDS = 2.0, 3, 5


def _numbered(texts: list[str]) -> tuple[list[str], list[np.ndarray], list[int]]:
    """Words of the texts, the texts as numbers of words, and the places of those without most of the near copies of earlier ones.

    A text counts as a near copy whose least or greatest hash of five words is known.
    """
    numbers: dict[str, int] = {}
    rows, seen, kept = [], set(), []
    for i, t in enumerate(texts):
        w = fold(t).split()
        rows.append(np.fromiter((numbers.setdefault(x, len(numbers)) for x in w), np.int32, len(w)))
        hashes = [zlib.crc32(" ".join(w[k : k + 5]).encode()) for k in range(max(1, len(w) - 4))]
        ends = {min(hashes), max(hashes)} if w else {-1}
        if not ends & seen:
            kept.append(i)
        seen |= ends
    return list(numbers), rows, kept


def _odds(words: list[str], sets: list[np.ndarray], toxic: list[int], rows: list[int], min_support: int) -> dict[int, float]:
    """Numbers of words of so many toxic texts at least with their log odds."""
    counts, n = [], []
    for y in (1, 0):
        own = [sets[i] for i in rows if bool(toxic[i]) == bool(y)]
        counts.append(np.bincount(np.concatenate([np.zeros(0, np.int64), *own]).astype(np.int64), minlength=len(words)))
        n.append(len(own))
    often = np.flatnonzero(counts[0] >= min_support)
    odds = np.log((counts[0][often] + 0.5) / (n[0] + 1)) - np.log((counts[1][often] + 0.5) / (n[1] + 1))
    return {int(f): float(w) for f, w in zip(often, odds, strict=True) if w >= LEAST_ODDS and len(words[f]) >= LEAST_LETTERS}


def _fit(texts: list[str], toxic: list[int], min_support: int, max_entries: int) -> list[tuple[str, str, float]]:
    """Rows (kind, key, weight): entry, exception and threshold.

    Near copies count once, or the words of one copied text would seem telling.  The threshold is the
    one with the fewest wrong answers on texts left out of the fold that their words were learned from.
    """
    words, numbered, rows = _numbered(texts)
    sets = [np.unique(x) for x in numbered]

    def learned(rows: list[int], support: int) -> list[tuple[str, str, float]]:
        odds = _odds(words, sets, toxic, rows, support)
        entries = sorted(odds, key=lambda f: (-odds[f], words[f]))[:max_entries]
        phrases: dict[str, list[int]] = {}
        among = np.zeros(len(words), bool)
        among[entries] = True
        clean = np.zeros(len(words), bool)
        for i in rows:
            if not toxic[i]:
                clean[sets[i]] = True
        doubtful = among & clean
        for i in rows if doubtful.any() else ():
            w = numbered[i]
            for k in np.flatnonzero(doubtful[w]).tolist():
                for p in (w[max(0, k - 1) : k + 1], w[k : k + 2]):
                    phrases.setdefault(" ".join(words[x] for x in p), [0, 0])[1 if toxic[i] else 0] += 1
        exceptions = sorted((p for p, (fine, other) in phrases.items() if fine >= 3 and not other and " " in p), key=lambda p: (-phrases[p][0], p))[:max_entries]
        return [("entry", f"{words[f]} ", odds[f]) for f in entries] + [("exception", p, 0.0) for p in exceptions]

    tried: list[tuple[float, int]] = []
    for part in range(FOLDS):
        own = Matcher(learned([i for k, i in enumerate(rows) if k % FOLDS != part], max(2, min_support * (FOLDS - 1) // FOLDS)))
        tried += [(own.raw(texts[i]), toxic[i]) for k, i in enumerate(rows) if k % FOLDS == part]
    best, cuts = (-1, 0.0), sorted({r for r, _ in tried if r > 0})
    for c in [cuts[len(cuts) * i // 300] for i in range(300)] if cuts else []:  # of equals the lowest
        best = max(best, (sum((r >= c) == bool(y) for r, y in tried), -c))
    below = max((r for r, _ in tried if r < -best[1]), default=0.0)  # no text tried lies between
    return [*learned(rows, min_support), ("threshold", "", below + (-best[1] - below) / 4 or 1.0)]


class Matcher:
    """Entries and exceptions as one automaton over folded texts: a blank before a key is a word's beginning, one after it its end."""

    def __init__(self, model: list[tuple[str, str, float]]):
        self.threshold = next((w for kind, _, w in model if kind == "threshold"), 1.0)
        self.auto = ahocorasick.Automaton()
        for kind, key, w in model:
            if kind != "threshold":
                form = f" {key.strip()} " if kind == "exception" or key[-1] == " " else f" {key}"
                self.auto.add_word(form, (len(form), w if kind == "entry" else None))
        if len(self.auto):
            self.auto.make_automaton()

    def raw(self, text: str | None) -> float:
        if not text or not len(self.auto):
            return 0.0
        folded = fold(text)
        found, covered = [], []
        for end, (size, w) in self.auto.iter(folded):
            (covered if w is None else found).append((end + 1 - size, end, w))
        total = sum(w for a, b, w in found if not any(c <= a and b <= d for c, d, _ in covered))
        return total / (1.0 + math.log1p(len(folded)) / 10) if total else 0.0

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, 4 * (self.raw(text) / self.threshold - 1)))))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, min_support: int = 5, max_entries: int = 2000, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> list[tuple[str, str, float]]:
    """Lexicon rows learned from at most max_rows labelled rows outside the held-out fold.

    A third of the sample at least is kept for rows labelled 1, if there are so many; which rows are
    taken depends on a hash of their ids only.
    """
    rows = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y is not null").filter(~held_out("id"))
    rows = rows.groupBy("id").agg(F.max("y").alias("y"))
    order = [F.xxhash64("id"), F.col("id")]
    picked = rows.filter("y = 1").orderBy(*order).limit(max_rows // 3).unionByName(rows.filter("y = 0").orderBy(*order).limit(max_rows - max_rows // 3))
    sample = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(picked), "id")  # at most max_rows rows

    def run(batches):
        texts: list[str] = []
        toxic: list[int] = []
        for b in batches:
            texts += b.column("text").to_pylist()
            toxic += b.column("y").to_pylist()
        kinds, keys, weights = zip(*_fit(texts, toxic, min_support, max_entries), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(keys), pa.array(weights, pa.float64())], names=["kind", "key", "weight"])

    fitted = sample.select("text", "y").repartition(1).mapInArrow(run, "kind string, key string, weight double")
    return [tuple(r) for r in fitted.collect()]  # at most 2 * max_entries + 1 rows


def score(docs: DataFrame, model: list[tuple[str, str, float]], text: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with a column of scores in 0 to 1; a column of that name is replaced."""
    kept = [c for c in docs.columns if c != out]
    source = docs.select(*[docs[c] for c in kept], docs[text].alias("__in"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]) + f", `{out}` double"

    def run(batches):
        matcher = Matcher(model)
        for b in batches:
            scores = [matcher.score(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], names=[*kept, out])

    bound_batches(docs.sparkSession)
    return source.mapInArrow(run, schema)
