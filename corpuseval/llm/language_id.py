"""Language by cross-parsing entropy with suffix automata.

For each language a suffix automaton is built of a bounded sample of labelled text.  A text is parsed against it from left
to right into the longest phrases that occur in the sample; the fewer phrases, the better the sample predicts the text.
Phrases are normalised to bits for each symbol (phrases x log2(sample length) / text length), and the language that needs
fewest wins.  The score is the share of its likelihood, at most ``CERTAIN`` symbols counted.

Symbols are lower-cased letters; every run of anything else is one space.  Letters that no sample holds are phrases
of their own.  Texts are parsed whole: runs of ``RUN`` symbols advance side by side, each as if a phrase began with it, and are
then parsed again from where the run before has ended until both parses are in one state, which they are after a few
phrases.  So phrases are the longest matches of the whole text, and a very long text takes no more memory than its own length.

Null texts, empty texts and texts without letters are ``und`` with score 0.  Without any labelled text all are ``und``.
Of languages that need equally many bits the first in order of text wins.
Repeated rows are judged alike; labels and sources are never read to predict; only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuseval.llm import _text
from corpuseval.llm._session import read_texts, refuse_clash

#: The sample: texts of each language and of all, symbols of each, and languages, those of most labelled rows; all that is collected.
SAMPLE_TEXTS, ALL_TEXTS, LANGUAGES = 200, 20_000, 1_000
SAMPLE_SYMBOLS = 40_000
#: Characters of one sampled text that are used, from a seeded place on, so that no text fills the sample.
SAMPLE_CHARS = 4_000
RUN, CHECK = 256, 32  # symbols of a run, and between comparisons of two parses
CERTAIN = 40
UNKNOWN = "und"
_SPACE = 1  # symbol; 0 is a letter that no sample holds
_CODES = 0x110000
#: Cells of all languages' dense tables; larger alphabets have sorted transitions, with the same parse.
DENSE_CELLS = 1 << 25


def _moves(symbols: list[int]) -> list[dict[int, int]]:
    """Next states of each state of the suffix automaton by symbol."""
    links, lengths, moves, last = [-1], [0], [{}], 0
    for s in symbols:
        here = len(moves)
        moves.append({})
        lengths.append(lengths[last] + 1)
        links.append(0)
        at = last
        while at >= 0 and s not in moves[at]:
            moves[at][s] = here
            at = links[at]
        if at >= 0:
            to = moves[at][s]
            if lengths[to] == lengths[at] + 1:
                links[here] = to
            else:
                twin = len(moves)
                moves.append(dict(moves[to]))
                lengths.append(lengths[at] + 1)
                links.append(links[to])
                links[to] = links[here] = twin
                while at >= 0 and moves[at].get(s) == to:
                    moves[at][s] = twin
                    at = links[at]
        last = here
    return moves


def automaton(symbols: list[int], width: int) -> np.ndarray:
    """Dense table ``state * width + symbol`` -> 4 * next state + phrases that end.

    A phrase ends before a symbol that does not follow it in the sample; a symbol that the sample lacks is a phrase of its
    own, after which the parse is at the root again.
    """
    return _dense(_moves(symbols), width)


def _dense(moves: list[dict[int, int]], width: int) -> np.ndarray:
    table = np.zeros((len(moves), width), dtype=np.int32)
    for state, known in enumerate(moves):
        table[state, list(known)] = list(known.values())
    first = table[0].copy()
    ends = 1 + (first == 0) * (np.arange(len(table)) > 0)[:, None]
    return np.where(table == 0, 4 * first + ends, 4 * table).astype(np.int32)


def _letters() -> np.ndarray:
    """For each code its lower-case letter, or 0 if it is none."""
    out = np.zeros(_CODES, dtype=np.int32)
    for code in range(_CODES):
        if chr(code).isalpha():
            out[code] = ord(chr(code).lower()[0])
    return out


def _codes(text: bytes) -> np.ndarray:
    """Code points of UTF-8."""
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int32)


class Model:
    """Automata of all languages over one alphabet."""

    def __init__(self, samples: dict[str, list[str]]):
        letters = _letters()
        cleaned = {lang: [letters[_codes(t.encode("utf-8", "replace"))] for t in texts] for lang, texts in sorted(samples.items())}
        seen = sorted({int(c) for texts in cleaned.values() for t in texts for c in np.unique(t)} - {0})
        symbol = np.zeros(_CODES, dtype=np.uint8 if len(seen) < 250 else np.int32)
        symbol[0] = _SPACE
        symbol[seen] = np.arange(2, len(seen) + 2)
        self.symbols = symbol[letters]  # of each code
        self.width = len(seen) + 2
        self.languages, moves, self.bits = [], [], []
        for lang, texts in cleaned.items():
            parts, n = [], 0
            for t in texts:
                s = self.squeeze(symbol[t])
                parts.append(s[: SAMPLE_SYMBOLS - n])
                n += len(parts[-1])
                if n >= SAMPLE_SYMBOLS:
                    break
            joined = np.concatenate(parts) if parts else np.zeros(0, symbol.dtype)
            if (joined > _SPACE).any():
                moves.append(_moves(joined.tolist()))
                self.languages.append(lang)
                self.bits.append(np.log2(len(joined) + 1))
        sizes = np.array([len(m) for m in moves], np.int64)
        self.dense = int(sizes.sum()) * self.width <= DENSE_CELLS
        if self.dense:
            self.offsets = ((np.cumsum(sizes) - sizes) * self.width).astype(np.int32)
            self.table = np.concatenate([_dense(m, self.width).ravel() for m in moves]) if moves else np.zeros(0, np.int32)
            return
        self.offsets = (np.cumsum(sizes) - sizes) * self.width
        self.first = np.zeros((len(moves), self.width), np.int32)
        for k, m in enumerate(moves):
            self.first[k, list(m[0])] = list(m[0].values())
        known = [(at + state * self.width + s, 4 * to) for at, m in zip(self.offsets.tolist(), moves, strict=True) for state, row in enumerate(m) for s, to in row.items()]
        known = np.array(sorted(known), np.int64)
        self.keys, self.table = known[:, 0].copy(), known[:, 1].astype(np.int32)

    def move(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """4 * next state + phrases that end, for each language (rows) and run."""
        if self.dense:
            return self.table[self.offsets[:, None] + state * self.width + symbols]
        key = self.offsets[:, None] + state.astype(np.int64) * self.width + symbols
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        first = self.first[:, symbols]
        return np.where(self.keys[at] == key, self.table[at], 4 * first + 1 + ((first == 0) & (state > 0)))

    @staticmethod
    def squeeze(symbols: np.ndarray) -> np.ndarray:
        """Runs of spaces as one."""
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != _SPACE) | (symbols[:-1] != _SPACE)
        return symbols[keep]

    def phrases(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each text for each language (rows: texts); the texts' symbols stand one after another."""
        runs = -(-lengths // RUN)
        owner = np.repeat(np.arange(len(lengths)), runs)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
        start = (np.cumsum(lengths) - lengths)[owner] + nth * RUN
        size = np.minimum(RUN, lengths[owner] - nth * RUN)
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        start, size, owner, nth = start[order], size[order], owner[order], nth[order]
        before = np.where(nth > 0, place[np.maximum(order - 1, 0)], -1)  # the run of the same text that ends where this begins
        after = np.full(len(order), -1)
        after[before[before >= 0]] = np.flatnonzero(before >= 0)
        shape = (RUN // CHECK, len(self.languages), len(order))
        states, counts = np.full(shape, -1, np.int32), np.zeros(shape, np.int32)  # after every ``CHECK`` symbols
        end, count = np.zeros(shape[1:], np.int32), np.zeros(shape[1:], np.int32)
        at, first = np.arange(len(order)), np.zeros(shape[1:], np.int32)
        while len(at):
            ended = end[:, at]
            self._walk(at, first, symbols, start, size, states, counts, end, count)
            at = after[at[(end[:, at] != ended).any(axis=0)]]
            at = np.sort(at[at >= 0])
            first = end[:, before[at]]
        out = np.zeros((len(lengths), len(self.languages)), np.int64)
        np.add.at(out, owner, count.T)
        last = after < 0
        np.add.at(out, owner[last], (end[:, last] > 0).T)
        return out

    def _walk(self, at, state, symbols, start, size, states, counts, end, count) -> None:
        """Parses the runs ``at`` (longest first) from ``state`` on, each until its end or until it is in the state of the parse before."""
        state, n, sizes = state.copy(), np.zeros(state.shape, np.int32), size[at]
        active = np.searchsorted(-sizes, -np.arange(RUN), "left")  # runs that are longer than each position
        for here in range(RUN // CHECK):
            begin = start[at]
            for j in range(here * CHECK, (here + 1) * CHECK):
                m = int(active[j])
                if not m:
                    break
                move = self.move(state[:, :m], symbols[begin[:m] + j])
                n[:, :m] += move & 3
                np.right_shift(move, 2, out=state[:, :m])
            going = int(active[(here + 1) * CHECK]) if (here + 1) * CHECK < RUN else 0  # the others are at their end
            end[:, at[going:]], count[:, at[going:]] = state[:, going:], n[:, going:]
            at, state, n = at[:going], state[:, :going], n[:, :going]
            met = (states[here][:, at] == state).all(axis=0)
            if met.any():
                change = n[:, met] - counts[here][:, at[met]]
                counts[here:, :, at[met]] += change
                count[:, at[met]] += change
                at, state, n, sizes = at[~met], state[:, ~met], n[:, ~met], sizes[:going][~met]
                active = np.searchsorted(-sizes, -np.arange(RUN), "left")
            if not len(at):
                return
            states[here][:, at], counts[here][:, at] = state, n

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each text of a slice."""
        n = len(offsets) - 1
        parts = [self.squeeze(self.symbols[_codes(data[offsets[k] : offsets[k + 1]].tobytes())]) for k in range(n)]
        lengths = np.array([len(p) if (p != _SPACE).any() else 0 for p in parts], dtype=np.int64)
        if not self.languages or not lengths.any():
            return [UNKNOWN] * n, np.zeros(n)
        rate = self.phrases(np.concatenate([p for p, size in zip(parts, lengths, strict=True) if size]), lengths) * np.array(self.bits)
        rate /= np.maximum(lengths, 1)[:, None]
        best = rate.argmin(axis=1)
        odds = np.exp2(-(rate - rate.min(axis=1, keepdims=True)) * np.minimum(lengths, CERTAIN)[:, None])
        return [self.languages[b] if size else UNKNOWN for b, size in zip(best, lengths, strict=True)], np.where(lengths > 0, 1 / odds.sum(axis=1), 0)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", seed: int = 42) -> Model:
    """A model of a bounded sample of every language: the texts that come first by a seeded hash, whatever their number.

    With more than ``ALL_TEXTS`` / ``SAMPLE_TEXTS`` languages each has a smaller sample; beyond ``LANGUAGES`` values of the label those of
    the fewest rows are not learnt.
    """
    counts = labelled.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).count()
    learnt = [r["lang"] for r in counts.orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    each = min(SAMPLE_TEXTS, ALL_TEXTS // max(len(learnt), 1))
    labelled = labelled.where(F.col(lang_col).isin(learnt))
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("whole"))
    place = F.pmod(F.xxhash64(F.lit(seed + 1), "whole"), F.greatest(F.length("whole") - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    rows = rows.select("lang", F.substring("whole", place.cast("int"), F.lit(SAMPLE_CHARS)).alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(seed), "text"), "text"))
    samples: dict[str, list[str]] = {}
    for lang, text in rows.withColumn("nth", first).where(F.col("nth") <= each).orderBy("lang", "nth").select("lang", "text").collect():
        samples.setdefault(lang, []).append(text)
    return Model(samples)


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score`` of every row's whole text."""
    refuse_clash(keep, {text_col, "lang_pred", "score"})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for low, high, data, offsets in _text.slices(batch.column(len(keep))):
                lang, score = known.predict(data, offsets)
                yield pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in batch.columns[: len(keep)]), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text_col).cast("string")).mapInArrow(run, f"{kinds}, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet").where(fold != 1)
    return identify(read_texts(spark, sf_dir).withColumn("held_out", fold == 1), train(labelled), ("doc_id", "held_out"))
