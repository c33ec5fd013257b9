"""Language identification by prediction by partial matching.

Each language has its own frozen counts at every byte context. A byte it has not seen there is coded by an
escape and the next shorter context, without the bytes already ruled out. The code length of a text in a
language is the sum over all its bytes. The shortest code names the language.

All strings that training texts hold are kept, in hash tables: for each string of a context and a byte the code
lengths of that byte in all languages, for each context those of an escape. A byte of a text costs one
lookup where its longest context has seen it, and one or two more for each escape. Languages are
dealt into blocks of ``BLOCK``, so any number of them can be learned.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import ends_of, map_texts, slices, text_bytes
from aerolith.operators.ranks import exact_quantiles
from aerolith.session import discard, stage

if TYPE_CHECKING:  # workers do without it
    import pandas as pd

#: Longest context in bytes.
ORDER = 4
#: Rows of each language that a model learns from, on average; all rows where a language has fewer.
SAMPLE_ROWS = 1_000
#: Languages whose code lengths stand in one table.
BLOCK = 16
#: Bytes of texts coded at a time, whatever the length of a text.
_STEP = 1 << 18

UNDETERMINED = "und"
_PAD = 10  # a line break stands in front of every text


class Lookup:
    """Open addressing in flat arrays: number of each known code, -1 for others."""

    def __init__(self, codes: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(2 * len(codes)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values = np.zeros(size, dtype=np.int64), np.full(size, -1, dtype=np.int32)
        left, at = np.arange(len(codes)), self._slot(codes)
        while len(left):
            free = self.keys[at] == 0
            slots, first = np.unique(at[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.keys[slots], self.values[slots] = codes[left[placed]], left[placed]
            rest = np.ones(len(left), dtype=bool)
            rest[placed] = False
            left, at = left[rest], (at[rest] + 1) & (size - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        at = self._slot(codes)
        keys, out = self.keys[at], self.values[at]
        open_ = np.flatnonzero((keys != codes) & (keys != 0))
        out[keys == 0] = -1
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            keys = self.keys[at[open_]]
            hit = keys == codes[open_]
            out[open_] = np.where(hit, self.values[at[open_]], -1)
            open_ = open_[~hit & (keys != 0)]
        return out


@dataclass
class Block:
    """Frozen code lengths of some languages. Codes are byte strings behind a leading 1 byte."""

    languages: list[str]
    order: int
    grams: np.ndarray  # codes of known strings of 1 to order + 1 bytes, ascending
    contexts: np.ndarray  # codes of known contexts of 0 to order bytes, ascending
    symbol_bits: np.ndarray  # gram x language
    escape_bits: np.ndarray  # context x language
    unknown_bits: float  # of a byte that no training text has, below the empty context
    _gram: Lookup = field(init=False, repr=False)
    _context: Lookup = field(init=False, repr=False)

    def __post_init__(self):
        self._gram, self._context = Lookup(self.grams), Lookup(self.contexts)

    def __getstate__(self) -> dict:
        """The tables are made anew where a block arrives; they are larger than what they are made of."""
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language. Works in steps over the bytes, so long texts take no more memory."""
        pad = bytes([_PAD]) * self.order
        starts, ends = ends_of([pad + t for t in texts])
        data = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), dtype=np.uint8)
        begins = starts + self.order
        total = np.zeros((len(texts), len(self.languages)))
        for a in range(0, len(data), _STEP):
            where = np.arange(a, min(a + _STEP, len(data)))
            owner = np.searchsorted(ends, where, side="right")
            real = where >= begins[owner]
            where, owner = where[real], owner[real]
            if not len(where):
                continue
            bits = self._bits(data, where)
            cuts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            total[owner[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.float64)
        return total

    def _bits(self, data: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Code length of the bytes at ``where``, longest contexts first."""
        out = np.zeros((len(where), len(self.languages)), dtype=np.float32)
        code = np.zeros(len(where), dtype=np.int64)
        for back in range(self.order, -1, -1):
            code = (code << 8) | data[where - back]
        left = np.arange(len(where))
        for length in range(self.order + 1, 0, -1):
            top = 1 << (8 * length)
            code = (code & (top - 1)) | top
            entry = self._gram.find(code)
            hit = entry >= 0
            out[left[hit]] += self.symbol_bits[entry[hit]]
            left, code = left[~hit], code[~hit]
            if not len(left):
                return out
            context = self._context.find(code >> 8)
            known = context >= 0
            out[left[known]] += self.escape_bits[context[known]]
        out[left] += np.float32(self.unknown_bits)
        return out


@dataclass
class PPM:
    """A model: blocks of languages in order of their names."""

    blocks: list[Block]

    @property
    def languages(self) -> list[str]:
        return [x for b in self.blocks for x in b.languages]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        return np.hstack([b.code_lengths(texts) for b in self.blocks])

    @property
    def bits(self) -> np.ndarray:
        """All code lengths of the first block, context x symbol x language; symbol 0 is any byte no training text has. To look at."""
        block = self.blocks[0]
        ones = block.grams[block.grams < 1 << 16] & 255
        seen = np.union1d(ones, [_PAD])
        out = np.zeros((len(block.contexts), len(seen) + 1, len(block.languages)))
        for i, context in enumerate(block.contexts.tolist()):
            known = [] if context == 1 else list(context.to_bytes(8, "big").lstrip(b"\0")[1:])
            for k, symbol in enumerate([next(b for b in range(256) if b not in seen), *seen.tolist()] if len(seen) < 256 else [0, *seen.tolist()]):
                data = np.array([0] * (block.order - len(known)) + [*known, symbol], dtype=np.uint8)
                out[i, k] = self._from(block, data, len(known))
        return out

    @staticmethod
    def _from(block: Block, data: np.ndarray, longest: int) -> np.ndarray:
        total = np.zeros(len(block.languages))
        for length in range(longest + 1, 0, -1):
            code = np.array([int.from_bytes(b"\1" + data[len(data) - length :].tobytes(), "big")])
            entry = block._gram.find(code)[0]
            if entry >= 0:
                return total + block.symbol_bits[entry]
            context = block._context.find(code >> 8)[0]
            if context >= 0:
                total = total + block.escape_bits[context]
        return total + block.unknown_bits

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, posterior under equal priors and code length in it of each text. Ties go to the first name."""
        bits = self.code_lengths(texts)
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(bits)), best]
        gap = (bits - least[:, None]) * np.log(2)
        names = self.languages
        return [names[i] for i in best], 1.0 / np.exp(-gap).sum(axis=1), least


def gram_counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): counts of byte strings of 1 to order + 1 bytes, as numbers with a leading 1 byte.

    ``rows`` has lang and text. Counts are added up in each slice before they are shuffled.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                names = np.array(part.column("lang").to_pylist(), dtype=object)
                texts = np.array(text_bytes(part.column("text")), dtype=object)
                for name in sorted(set(names)):
                    chosen = [bytes([_PAD]) * order + t for t in texts[names == name]]
                    starts, ends = ends_of(chosen)
                    data = np.frombuffer(b"".join(chosen), dtype=np.uint8).astype(np.int64)
                    inside = np.zeros(len(data), dtype=bool)
                    for a, b in zip(starts, ends, strict=True):
                        inside[a + order : b] = True
                    code, place = np.ones(len(data), dtype=np.int64), np.flatnonzero(inside)
                    for length in range(1, order + 2):
                        # the string of this length that ends at each place
                        code = np.zeros(len(place), dtype=np.int64) + 1
                        for back in range(length - 1, -1, -1):
                            code = (code << 8) | data[place - back]
                        grams, n = np.unique(code, return_counts=True)
                        yield pa.RecordBatch.from_pydict({"lang": [name] * len(grams), "gram": grams, "n": n.astype(np.int64)})

    counted = rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _marked(rows: DataFrame, sample_rows: int) -> DataFrame:
    """doc_id, lang, text of the rows that have both, and whether a model learns from the row, by a hash of the id."""
    known = rows.filter("lang is not null and text is not null").select("doc_id", "lang", "text")
    # Staged: a row a language of known size, so the texts stay where they are.
    share = stage(known.groupBy("lang").agg((F.lit(float(sample_rows)) / F.count(F.lit(1))).alias("_share")))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return known.withColumn("_draw", draw).join(share, "lang").select("doc_id", "lang", "text", (F.col("_draw") < F.col("_share")).alias("_learned"))


def training_sample(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """lang and text of about ``sample_rows`` rows of each language, chosen by a hash of the id.

    A language with fewer rows gives all of them.
    """
    return _marked(rows, sample_rows).filter("_learned").select("doc_id", "lang", "text")


def _sized(code: np.ndarray) -> np.ndarray:
    """Bytes behind the leading 1 byte."""
    return sum((code >= 1 << (8 * k)).astype(np.int64) for k in range(1, 7))


def _place(codes: np.ndarray, of: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(codes, of), len(codes) - 1)
    if (codes[at] != of).any():
        raise ValueError("a string is known without its shorter ones")
    return at


def build_block(counts: pd.DataFrame, languages: list[str], alphabet: np.ndarray, order: int) -> Block:
    """Code lengths from counts (lang, gram, n) of strings, lang a place in ``languages``.

    With a string, those it ends with must be there.
    """
    lang = counts["lang"].to_numpy(np.int64)
    strings = counts["gram"].to_numpy(np.int64)
    grams = np.union1d(strings, alphabet | 256)  # bytes that only other languages or the pad have stand alone too
    row = np.searchsorted(grams, strings)
    contexts = np.unique(np.append(grams >> 8, 1))
    n = np.zeros((len(grams), len(languages)))
    n[row, lang] = counts["n"].to_numpy(np.float64)
    of, length = _place(contexts, grams >> 8), _sized(grams)
    shape = (len(contexts), len(languages))
    total, kinds = np.zeros(shape), np.zeros(shape)
    np.add.at(total, of, n)
    np.add.at(kinds, of, n > 0)
    chance = np.zeros_like(n)  # of the byte, in its context
    escape = np.ones(shape)  # factor from the chance in the shorter context to that in this one, for a byte not seen
    for size in range(1, order + 2):
        here = np.flatnonzero(length == size)
        if not len(here):
            break
        if size == 1:
            below = np.full((len(here), len(languages)), 1.0 / 256)
        else:
            top = 1 << (8 * (size - 1))
            below = chance[_place(grams, (grams[here] & (top - 1)) | top)]
        at = of[here]
        seen = n[here] > 0
        ruled = np.zeros(shape)
        np.add.at(ruled, at, np.where(seen, below, 0.0))
        left = 1.0 - ruled
        out = np.where((left > 1e-12) & (total > 0), kinds, 0.0)
        whole = np.maximum(total + out, 1.0)
        mine = np.unique(at)
        factor = np.where(total > 0, out / whole / np.maximum(left, 1e-12), 1.0)
        escape[mine] = factor[mine]
        chance[here] = np.where(seen, n[here] / whole[at], below * factor[at])
    bits = lambda x: -np.log2(np.maximum(x, 1e-30)).astype(np.float32)
    unknown = max(1.0 - len(alphabet) / 256, 1.0 / 256)
    return Block(languages, order, grams, contexts, bits(chance), bits(escape), float(-np.log2(unknown)))


def fit(rows: DataFrame, order: int = ORDER, sample_rows: int = SAMPLE_ROWS, block: int = BLOCK) -> PPM | None:
    """A model of rows (doc_id, lang, text); None without any.

    The strings of a bounded sample (``sample_rows`` rows of each language) are counted on the executors, all
    of them are kept. Languages reach the driver in blocks of ``block``, a table each; a model's size is its strings x
    the languages of their block x 4 bytes.
    """
    counts = stage(gram_counts(training_sample(rows, sample_rows), order))
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    alphabet = np.union1d(np.array([r[0] & 255 for r in counts.filter(F.col("gram") < 1 << 16).select("gram").distinct().collect()], dtype=np.int64), [_PAD])
    blocks = []
    for a in range(0, len(languages), block):
        names = languages[a : a + block]
        place = (F.array_position(F.array(*[F.lit(x) for x in names]), F.col("lang")) - 1).cast("int").alias("lang")
        blocks.append(build_block(counts.filter(F.col("lang").isin(names)).select(place, "gram", "n").toPandas(), names, alphabet, order))
    discard(counts)
    return PPM(blocks) if blocks else None


def usual_rates(rows: DataFrame, model: PPM, share: float = 0.99, sample_rows: int = SAMPLE_ROWS) -> dict[str, float]:
    """Bits a byte that ``share`` of the texts of each language stay under, in the language's own code.

    Measured on all rows (doc_id, lang, text) but those learned from; where a language has no others, on those. The
    quantile is exact. A number a language reaches the driver.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def work():
        ppm = shared.value

        def run(texts: list[bytes]) -> dict[str, list]:
            bits = ppm.code_lengths(texts)
            return {"bits": pa.array(bits.tolist(), pa.list_(pa.float64())), "size": [len(t) for t in texts]}

        return run

    names = model.languages
    coded = map_texts(_marked(rows, sample_rows), "bits array<double>, size long", work, keep=("lang", "_learned"))
    place = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("lang")).cast("int")
    own = F.try_element_at("bits", place)
    rates = stage(coded.filter((F.col("size") >= LEAST_BYTES) & own.isNotNull()).select(place.alias("place"), "_learned", (own / F.col("size")).alias("rate")))
    only_learned = {r.place: r.all for r in rates.groupBy("place").agg(F.every("_learned").alias("all")).collect()}
    columns = {f"_{i}": F.when((F.col("place") == i) & (F.col("_learned") == F.lit(every)), F.col("rate")) for i, every in only_learned.items()}
    found = {}
    if columns:
        found = {names[int(r.feature[1:]) - 1]: r.quantile for r in exact_quantiles(rates.select(*[c.alias(n) for n, c in columns.items()]), list(columns), [share]).collect()}
    discard(rates)
    shared.unpersist()
    return found


#: Texts shorter than this tell nothing of their rate.
LEAST_BYTES = 64
#: A text may take this many times the usual rate of its language, and this many bits besides.
RATE_MARGIN = 1.3
BITS_MARGIN = 96.0


def identify(docs: DataFrame, model: PPM | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred, score and bits of each text.

    lang_pred is ``und`` with score 0 for a text that is null or has no letter, and for all if nothing
    was learned. Otherwise score is the posterior of the language under equal priors, over 0 and at
    most 1, and bits the code length of the whole text in it. Rows are kept one for one, repeated ones too; columns
    not in ``keep`` but text are not read. An empty table gives an empty result.
    """
    if model is None:
        return docs.select(*keep, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        ppm = shared.value

        def run(texts: list[bytes]) -> dict[str, list]:
            names, score, bits = ppm.predict(texts)
            return {"lang_pred": names, "score": score, "bits": bits}

        return run

    lettered = docs.withColumn("_letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    scored = map_texts(lettered, "lang_pred string, score double, bits double", work, keep=(*keep, "_letters"))
    named = F.when(F.col("_letters"), F.col("lang_pred")).otherwise(F.lit(UNDETERMINED))
    return scored.select(*keep, named.alias("lang_pred"), F.when(F.col("_letters"), F.col("score")).otherwise(0.0).alias("score"), "bits")


def usual_text(rates: dict[str, float], text: str = "text", margin: float = RATE_MARGIN, slack: float = BITS_MARGIN) -> Column:
    """True where the code of a text (lang_pred, bits) is as short as texts of that language usually have it.

    The named language is only the best of those learned; a text in none of them, or noise, takes far more
    bits a byte than its texts do. Texts too short to tell are usual, and so are all of a language without a rate.
    """
    limit = F.lit(None).cast("double")
    for language, rate in rates.items():
        limit = F.when(F.col("lang_pred") == language, F.lit(margin * rate)).otherwise(limit)
    return F.coalesce(F.col("bits") <= limit * F.octet_length(text) + slack, F.lit(True))
