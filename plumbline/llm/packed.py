"""Token ids as Simple-8b words.

A 64-bit word has a selector in its top four bits and as many ids as fit in the
60 bits below, all of one width. Ids that need more than 60 bits are escaped:
one selector announces that the next word is the id itself. Every document starts
at a word of its own; a block holds the words of consecutive documents and the
offset at which each one starts, so one document or a whole block decodes with a
few array operations.

A file is a Parquet table of such blocks: ``part, block, first_doc, start`` (ids
in front of the block within its part), ``doc_ids, n_tokens, offsets, words``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from tokenizers import Tokenizer

from plumbline.llm.common import batches_of, slices, split_words

#: Ids per word and bits per id of each selector.
COUNTS = [240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
WIDTHS = [0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
#: Bits of the ids that most tokenizers have.
BITS = np.frexp(np.arange(1 << 16))[1].astype(np.uint8)
#: Selector 1 would hold 120 zeros; here it is the escape.
ESCAPE = 1
END_ID = 1
#: Words of ids in a block, unless one document has more.
BLOCK_WORDS = 1 << 16
#: Words a worker remembers with their ids; beyond, those not met in the last pieces are forgotten.
REMEMBERED, RECENT = 250_000, 8
#: Bytes of text encoded at a time; word tables and packing take many times that.
PIECE_BYTES = 1 << 20
#: Where each word starts follows from the one before: so many doublings of the step are taken at once.
HOPS = 3
#: Words encoded in one call.
GROUP = 1 << 14
MARK = "\x01"
#: A letter that is one still when normalised ends a piece where a mark follows it; a space between them leaves the ids as they are.
LETTERS = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+").fullmatch
BEFORE_MARK, SET_APART = r"([a-zA-ZÀ-ÖØ-öø-ÿ])([!-/:-@\[-`{-~])", r"\1 \2"
BLOCKS = "part int, block int, first_doc long, start long, doc_ids array<long>, n_tokens array<long>, offsets array<long>, words binary"


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits of every id, 61 for all above 60."""
    if ids.max() < len(BITS):
        return BITS[ids]
    return np.searchsorted(np.uint64(1) << np.arange(61, dtype=np.uint64), ids, side="right").astype(np.uint8)


def pack(ids: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Words of ``ids`` and how many belong to each document.

    ``ends`` are the ends of the documents in ``ids``. Each word takes as many ids
    as its widest one allows and none of the next document.
    """
    ids = np.ascontiguousarray(ids, np.uint64)
    size = len(ids)
    ends = np.array([size]) if ends is None else np.asarray(ends)
    if not size:
        return ids, np.zeros(len(ends), np.int64)
    stop = np.repeat(ends, np.diff(ends, prepend=0))
    room = np.minimum(stop - np.arange(size), 255).astype(np.uint8)
    widest, span = _bits(ids), 1
    # Selectors by rising counts: an id that starts a word of one could start a word of those before.
    order = [s for s in range(len(COUNTS) - 1, -1, -1) if s != ESCAPE]
    level = np.zeros(size, np.uint8)
    for selector in order:
        while span < min(COUNTS[selector], size):
            step = min(span, COUNTS[selector] - span, size - span)
            widest[:-step] = np.maximum(widest[:-step], widest[step:])
            span += step
        fits = (widest <= WIDTHS[selector]) & (room >= COUNTS[selector])
        if not fits.any():
            break
        level += fits
    chosen = np.array([ESCAPE, *order], np.int8)[level]
    hop = np.append(np.arange(size) + np.array([1, *[COUNTS[s] for s in order]])[level], size)
    far = hop
    for _ in range(HOPS):
        far = far[far]
    steps, starts, i = memoryview(far), [], 0
    while i < size:
        starts.append(i)
        i = steps[i]
    between = [np.array(starts)]
    while len(between) < 1 << HOPS:
        between.append(hop[between[-1]])
    first = np.stack(between, axis=1).ravel()
    first = first[first < size]
    selectors = chosen[first]
    extra = selectors == ESCAPE
    place = np.arange(len(first)) + np.cumsum(extra) - extra
    words = np.zeros(len(first) + int(extra.sum()), np.uint64)
    words[place] = selectors.astype(np.uint64) << np.uint64(60)
    words[place[extra] + 1] = ids[first[extra]]
    for selector in np.unique(selectors).tolist():
        if selector == ESCAPE or not WIDTHS[selector]:
            continue
        own = selectors == selector
        shifts = np.arange(COUNTS[selector], dtype=np.uint64) * np.uint64(WIDTHS[selector])
        taken = ids[first[own][:, None] + np.arange(COUNTS[selector])]
        words[place[own]] |= np.bitwise_or.reduce(taken << shifts, axis=1)
    before = np.searchsorted(first, ends)
    return words, np.diff(before + np.concatenate([[0], np.cumsum(extra)])[before], prepend=0)


def unpack(words: np.ndarray) -> np.ndarray:
    """Ids of a run of words."""
    words = np.asarray(words, np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    marked = np.flatnonzero(selectors == ESCAPE)
    raw = np.zeros(len(words), bool)
    last = -2
    for i in marked.tolist():  # a raw word may look like an escape itself
        if i != last + 1:
            raw[i + 1] = True
            last = i
    counts = np.array(COUNTS)[selectors]
    counts[raw] = 1
    escapes = np.flatnonzero(raw) - 1
    counts[escapes] = 0
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    begins = ends - counts
    out[begins[raw]] = words[raw]
    plain = ~raw
    plain[escapes] = False
    for selector in np.unique(selectors[plain]).tolist():
        if not WIDTHS[selector]:
            continue
        own = np.flatnonzero(plain & (selectors == selector))
        shifts = np.arange(COUNTS[selector], dtype=np.uint64) * np.uint64(WIDTHS[selector])
        mask = np.uint64((1 << WIDTHS[selector]) - 1)
        out[begins[own][:, None] + np.arange(COUNTS[selector])] = words[own][:, None] >> shifts & mask
    return out


class Encoder:
    """Ids of whole texts through the tokenizers library.

    The tokenizer drops white space, so a text's ids are its words' ids in order.
    New words are encoded together: those of letters alone, one piece each, are cut
    where a token ends a piece, the others are set apart by a mark that is one token
    of its own. Ids of known words lie in one flat array. The library takes special
    tokens out of a text before anything else, so a text that holds one is encoded
    by itself.
    """

    def __init__(self, spec: str):
        self.spec = spec

    def prepare(self) -> None:
        if not hasattr(self, "tokenizer"):
            self.tokenizer = Tokenizer.from_str(self.spec)
            self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
            # A word of a text without special tokens holds none, but its lowered form may look like one.
            self.tokenizer.encode_special_tokens = True
            self.ends_piece: dict[str, bool] = {}
            self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
            suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
            vocabulary = self.tokenizer.get_vocab() if suffix else {}
            self.last = np.zeros(1 + max(vocabulary.values(), default=0), bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            self.piece = 0
            self.forget([], np.empty(0, np.int64))

    def forget(self, words: list[str], slots: np.ndarray) -> None:
        """Remember ``words``, which lie in ``slots``, and no others."""
        taken = self.lengths[slots] if len(slots) else np.empty(0, np.int64)
        flat = self.flat[_runs(self.starts[slots], taken)] if len(slots) else np.empty(0, np.uint32)
        met = self.met[slots] if len(slots) else np.empty(0, np.int64)
        self.known = {w: i for i, w in enumerate(words)}
        # The end id lies in front of all words.
        self.flat, self.lengths, self.starts, self.met = np.append(np.uint32(END_ID), flat), taken, 1 + np.cumsum(taken) - taken, met

    def closes(self, letter: str) -> bool:
        """Is the character a letter still when the tokenizer has normalised it?"""
        if letter not in self.ends_piece:
            normal = self.tokenizer.normalizer.normalize_str(letter) if self.tokenizer.normalizer else letter
            self.ends_piece[letter] = normal[-1:].isalpha()
        return self.ends_piece[letter]

    def slots(self, words: list[str]) -> np.ndarray:
        """Where the ids of every word lie."""
        found = list(map(self.known.get, words))
        places = [i for i, slot in enumerate(found) if slot is None]
        self.learn([words[i] for i in places])
        for i in places:
            found[i] = self.known[words[i]]
        return np.array(found, np.int64)

    def learn(self, words: list[str]) -> None:
        """Encode words that aren't known."""
        letters = [w for w in words if LETTERS(w) or w.isalpha() and all(map(self.closes, w))]
        rest, found = [*set(words).difference(letters)], []
        for start in range(0, len(letters), GROUP):
            group = letters[start : start + GROUP]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1 if len(self.last) > 1 else []
            # Each word has a piece at least, so as many pieces as words are one each.
            if len(ends) == len(group) and ends[-1] == len(ids):
                found.append((group, ids, np.diff(ends, prepend=0)))
            else:
                rest += group
        plain = [w for w in rest if MARK not in w] if len(self.mark) == 1 else []
        for start in range(0, len(plain), GROUP):
            group = plain[start : start + GROUP]
            text = "".join([f"{MARK} {word} " for word in group])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            marks = np.flatnonzero(ids == self.mark[0])
            found.append((group, np.delete(ids, marks), np.diff(marks, append=len(ids)) - 1))
        for word in set(rest).difference(plain):
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            found.append(([word], np.array(ids, np.uint32), np.array([len(ids)])))
        if found:
            groups, ids, lengths = zip(*found)
            self.store([word for group in groups for word in group], np.concatenate(ids), np.concatenate(lengths))

    def store(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Remember words whose ids stand in a row."""
        self.known.update(zip(words, range(len(self.lengths), len(self.lengths) + len(words))))
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(lengths) - lengths)
        self.lengths, self.flat = np.append(self.lengths, lengths), np.append(self.flat, ids)
        self.met = np.append(self.met, np.full(len(words), self.piece))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each text closed by ``END_ID``, and how many every text has."""
        self.prepare()
        held = np.zeros(len(texts), bool)
        for token in self.special:
            held |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False).astype(bool)
        if held.any() and not hasattr(self, "library"):
            self.library = Tokenizer.from_str(self.spec)
        alone = [self.library.encode(texts[i].as_py(), add_special_tokens=False).ids for i in np.flatnonzero(held).tolist()]
        texts = pc.if_else(pa.array(held), "", texts) if held.any() else texts
        ends, codes, words = split_words(pc.replace_substring_regex(texts, BEFORE_MARK, SET_APART), lower=True)
        if len(self.known) > REMEMBERED:
            recent = np.flatnonzero(self.met > self.piece - RECENT)
            self.forget(np.array([*self.known], object)[recent].tolist(), recent)
        self.piece += 1
        slots = self.slots(words)
        self.met[slots] = self.piece
        # A text encoded by itself stands as one more word, and so does the end.
        codes = np.insert(codes, ends[1:][held], len(words) + 1 + np.arange(len(alone)))
        ends = ends + np.concatenate([[0], np.cumsum(held)])
        codes = np.insert(codes, ends[1:], len(words))
        lengths = np.array([1, *[len(x) for x in alone]], np.int64)
        starts = np.concatenate([self.starts[slots], [0], len(self.flat) + np.cumsum(lengths[1:]) - lengths[1:]])
        flat = np.append(self.flat, np.array([i for ids in alone for i in ids], np.uint32)) if alone else self.flat
        taken = np.append(self.lengths[slots], lengths)[codes]
        return flat[_runs(starts[codes], taken)], np.diff(np.cumsum(taken)[ends[1:] + np.arange(len(ends) - 1)], prepend=0)


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of runs that begin at ``starts``, one run after the other."""
    stops = np.cumsum(lengths)
    return np.repeat(starts - (stops - lengths), lengths) + np.arange(stops[-1] if len(stops) else 0)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gather sorted documents of a partition into blocks."""
    part, block, start, size, held = None, 0, 0, 0, []

    def flush() -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(w) // 8 for _, _, w in held])])[:-1]
        row = {
            "part": [part], "block": [block], "first_doc": [held[0][0]], "start": [start],
            "doc_ids": [[d for d, _, _ in held]], "n_tokens": [[n for _, n, _ in held]],
            "offsets": [offsets.tolist()], "words": [b"".join(w for _, _, w in held)],
        }
        return pa.RecordBatch.from_pydict(row, schema=BLOCK_SCHEMA)

    for batch in batches:
        for own, doc, n, words in zip(*[batch.column(c).to_pylist() for c in ("part", "doc_id", "n_tokens", "words")]):
            if held and (own != part or size + len(words) // 8 > BLOCK_WORDS):
                yield flush()
                start += sum(x[1] for x in held)
                block, size, held = block + 1, 0, []
            if own != part:
                part, block, start = own, 0, 0
            held.append((doc, n, words))
            size += len(words) // 8
    if held:
        yield flush()


BLOCK_SCHEMA = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("start", pa.int64())]
    + [(c, pa.list_(pa.int64())) for c in ("doc_ids", "n_tokens", "offsets")]
    + [("words", pa.binary())]
)


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Encode every text, append ``END_ID``, and write blocks in ascending id order below ``path``.

    Part ``k`` holds ids between the k-th pair of ``parts`` quantiles. Null texts
    count as empty and hold the end id alone, null ids come first, rows that repeat
    an id follow each other. An empty table writes no block. ``tokenizer`` is the
    file's path, read on the driver and broadcast.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(Encoder(file.read()))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    probs = [i / parts for i in range(1, parts)]
    edges = sorted(set(given.select(F.percentile_approx("doc_id", probs or [0.5], 10 * parts)).first()[0] or []))
    below = F.array(*[F.lit(e) for e in edges]) if edges else F.array().cast("array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", PIECE_BYTES):
                ids, sizes = shared.value.encode(piece.column("text"))
                ends = np.cumsum(sizes)
                words, counts = pack(ids, ends)
                raw, stops = words.astype("<u8"), np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        pa.array(sizes),
                        pa.array([raw[j - n : j].tobytes() for j, n in zip(stops, counts)], pa.binary()),
                    ],
                    names=["doc_id", "n_tokens", "words"],
                )

    with batches_of(spark, 1024):
        coded = given.mapInArrow(run, "doc_id long, n_tokens long, words binary")
        coded = coded.withColumn("part", F.coalesce(F.size(F.filter(below, lambda e: e < F.col("doc_id"))), F.lit(0)))
        ordered = coded.repartition(parts, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first())
        ordered.mapInArrow(_blocks, BLOCKS).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents in the files below ``path``.

    ``ids`` are little-endian unsigned 32-bit integers. Only the totals of the
    parts, of which there are as many as the writer was told, are summed in order.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    total = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    sizes = blocks.groupBy("part").agg(F.sum(total).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = unpack(np.frombuffer(row["words"], "<u8")).astype("<u4")
                ends = np.cumsum(row["n_tokens"])
                starts = ends - row["n_tokens"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts + row["start"] + row["before"], pa.int64()),
                        pa.array(row["n_tokens"], pa.int64()),
                        pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    # One row per part, and the number of parts is the writer's parameter.
    placed = blocks.join(F.broadcast(before), "part").select("start", "before", "doc_ids", "n_tokens", "words")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def read_document(block: dict, index: int) -> np.ndarray:
    """Ids of the ``index``-th document of one block row, without decoding the others."""
    offsets = block["offsets"]
    words = np.frombuffer(block["words"], "<u8")
    return unpack(words[offsets[index] : offsets[index + 1] if index + 1 < len(offsets) else len(words)])
