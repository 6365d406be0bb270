"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. An n-gram's vector binds
(multiplies) its letters' vectors, each permuted (rolled) by its place; a text's
profile bundles (adds) the vectors of all its n-grams, and a language's prototype
bundles those of its example texts, each brought to length 1. A text gets the
language whose prototype has the largest cosine with its profile.

The fit takes a sample of about `per_language` different texts of each language,
chosen by a hash of the text: a documented bound. Prediction covers whole texts,
in slices where they are long, in one map over the documents without a shuffle.

Nulls and edges: a null text, or one without a letter, is `und` with score 0; a row
whose language is null teaches nothing; ties go to the smaller language code; with
no examples at all every text is `und`.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches

UNDETERMINED = "und"
#: Slots for letters; letters beyond the common ones share slots by their code points.
SLOTS = 64
#: Texts and characters that are bundled at once.
TEXTS, CHARS = 256, 1 << 21


class Profiler:
    """Item memory for letters, and profiles of texts by n-grams."""

    def __init__(self, size: int = 1024, n: int = 3, seed: int = 7):
        self.size, self.n = size, n
        rng = np.random.default_rng(seed)
        letters = rng.integers(0, 2, (SLOTS, size)).astype(np.int8) * 2 - 1
        self.rolled = [np.roll(letters, k, axis=1) for k in range(n)]
        # slot 0 parts words; letters take the others, upper case as lower case
        points = np.zeros(0x110000, np.uint8)
        self.letter = np.zeros(0x110000, bool)
        for c in range(0x3000):
            if (ch := chr(c)).isalpha():
                low = ord(ch.lower()) if len(ch.lower()) == 1 else c
                points[c] = low - 96 if 97 <= low <= 122 else 27 + (low * 40503 >> 4) % (SLOTS - 27)
                self.letter[c] = True
        for start, stop in self._other_letters():
            low = np.arange(start, stop)
            points[start:stop] = 27 + (low * 40503 >> 4) % (SLOTS - 27)
            self.letter[start:stop] = True
        self.slot = points
        self.grams: dict[int, np.ndarray] = {}

    @staticmethod
    def _other_letters():
        at = None
        for c in range(0x3000, 0x110001):
            is_letter = c < 0x110000 and not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] == "L"
            if is_letter and at is None:
                at = c
            elif not is_letter and at is not None:
                yield at, c
                at = None

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """The bound vectors of some n-grams (numbers in base SLOTS)."""
        out = np.ones((len(grams), self.size), np.int8)
        for k in range(self.n):
            out *= self.rolled[self.n - 1 - k][(grams // SLOTS**k) % SLOTS]
        return out

    def bundles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Profiles of some texts (texts x size), and whether each has a letter."""
        out, has = np.zeros((len(texts), self.size), np.float32), np.zeros(len(texts), bool)
        group, chars = [], 0
        for k, t in enumerate(texts):
            for at in range(0, len(t or ""), CHARS):  # the slices of a long text share a row; they overlap by n - 1
                part = t[max(0, at - self.n + 1) : at + CHARS]
                group.append((k, part))
                chars += len(part)
                if chars >= CHARS or len(group) >= TEXTS:
                    self._add(group, out, has)
                    group, chars = [], 0
        self._add(group, out, has)
        return out, has

    def _add(self, group, out, has) -> None:
        if not group:
            return
        # a word break on both sides of each text
        points = np.frombuffer(" ".join(p for _, p in group).join("  ").encode("utf-32-le", "surrogatepass"), "<u4")
        lens = np.array([len(p) + 1 for _, p in group])
        rows = np.repeat(np.arange(len(group)), lens)
        slots = self.slot[points].astype(np.int64)
        letters = np.bincount(rows, self.letter[points[1:]], len(group)) > 0
        gram = np.zeros(len(slots) - self.n + 1, np.int64)
        for k in range(self.n):
            gram = gram * SLOTS + slots[k : len(slots) - self.n + 1 + k]
        rows = rows[: len(gram)]
        middle = slots[1 : len(gram) + 1] > 0  # n-grams around breaks alone say nothing
        gram, rows = gram[middle], rows[middle]
        seen = np.zeros(SLOTS**self.n, bool)
        seen[gram] = True
        kinds = np.flatnonzero(seen)
        place = np.cumsum(seen) - 1
        counts = np.bincount(rows * len(kinds) + place[gram], minlength=len(group) * len(kinds)).reshape(len(group), len(kinds)).astype(np.float32)
        owners = np.array([k for k, _ in group])
        for at in range(0, len(kinds), 4096):
            np.add.at(out, owners, counts[:, at : at + 4096] @ self.vectors(kinds[at : at + 4096]).astype(np.float32))
        np.logical_or.at(has, owners, letters)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


_PROFILERS: dict[tuple, Profiler] = {}


def profiler(size: int, n: int) -> Profiler:
    if (size, n) not in _PROFILERS:
        _PROFILERS[size, n] = Profiler(size, n)
    return _PROFILERS[size, n]


class LanguageModel:
    """Prototypes by language, in order of the codes."""

    def __init__(self, languages: list[str], prototypes: np.ndarray, size: int, n: int):
        self.languages, self.prototypes, self.size, self.n = languages, prototypes, size, n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and cosine (0 to 1) of each text."""
        profiles, has = profiler(self.size, self.n).bundles(texts)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        cosines = unit(profiles) @ self.prototypes.T
        best = cosines.argmax(1)
        score = np.clip(cosines[np.arange(len(texts)), best].astype(float), 0, 1)
        return [self.languages[b] if h else UNDETERMINED for b, h in zip(best, has, strict=True)], np.where(has, score, 0.0)


def fit(examples: DataFrame, lang_col: str = "lang", text_col: str = "text", per_language: int = 300, size: int = 1024, n: int = 3) -> LanguageModel:
    """Prototypes from about `per_language` different texts of each language, chosen by hash.

    Only sums of profiles reach the driver: `size` numbers for each language.
    """
    small_batches(examples.sparkSession)
    labelled = examples.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    if not counts:
        return LanguageModel([], np.zeros((0, size), np.float32), size, n)
    share = F.element_at(F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, min(1.0, per_language / v))]), F.col("lang"))
    hashed = labelled.withColumn("h", F.xxhash64("text"))
    chosen = hashed.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).dropDuplicates(["lang", "h"])

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            profiles, _ = profiler(size, n).bundles(batch.column(1).to_pylist())
            for lang, p in zip(batch.column(0).to_pylist(), unit(profiles), strict=True):
                sums[lang] = sums.get(lang, 0) + p.astype(np.float64)
        langs = np.repeat(list(sums), size) if sums else []
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.tile(np.arange(size), len(sums))), pa.array(np.concatenate(list(sums.values())) if sums else [], pa.float64())], ["lang", "place", "x"])

    # rounded to binary fractions, so that the order of the partitions cannot change a sum
    exact = F.sum(F.round(F.col("x") * (1 << 40)).cast("decimal(38,0)")).alias("x")
    total: dict[str, np.ndarray] = {}
    for row in chosen.mapInArrow(lean(run), "lang string, place long, x double").groupBy("lang", "place").agg(exact).collect():
        total.setdefault(row.lang, np.zeros(size))[row.place] = float(row.x)
    languages = sorted(total)
    return LanguageModel(languages, unit(np.array([total[x] for x in languages])).astype(np.float32), size, n)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The kept columns of the documents with the language and its cosine, under these names."""
    small_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    picked = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("_text_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])

    def run(batches):
        for batch in batches:
            lang, score = model.predict(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, *names])

    return picked.mapInArrow(lean(run), (schema + ", " if schema else "") + f"`{names[0]}` string, `{names[1]}` double")
