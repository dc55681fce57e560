"""Encoding a corpus with a public byte-level BPE by corpus-level merge replay.

1. Texts are cut into words by the tokenizer's pattern. The corpus is taken
   in stretches; a stored table has a row for each distinct word of a stretch,
   with its number there, and one for each text, as a list of such numbers.
2. The distinct words of the whole corpus are gathered, each once, and lie end
   to end in arrays of token ids, one for each part of that table; an inverted
   index leads from each pair of neighbours, by the rank of its merge, to the
   positions where it stands. Merges are applied in rank order, each at all
   its positions at once, and only the neighbours it touches are indexed anew.
3. Ids of words go back to the stretches that hold them, and each text's ids
   are read off its word numbers, one stretch at a time.

No row is larger than its text, so readers, which take rows by the thousand,
hold no more than those of the corpus itself do.

A word is a row once for each stretch that holds it, so no word, however
often it stands in the corpus, has more rows than there are stretches; a
stretch has as many rows as distinct words, so its share of them is small.

Texts are taken whole, whatever their length. An empty or null text has the
empty list; strings of special tokens are ordinary text.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.shipping import ship
from lodestrata.shared import store

ship(__name__)

#: The vocabulary's folder (a parameter of every function) and the words of the byte-level pattern.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Positions whose pairs are looked up at once, and the bits of a position in a number that holds a rank before it.
SPAN, PLACE = 1 << 18, 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary.

    Printable Latin-1 bytes stand for themselves; the others take the code
    points from 256 on, in order.
    """
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    symbols, spare = [], 256
    for b in range(256):
        symbols.append(chr(b if b in kept else spare))
        spare += b not in kept
    return symbols


class Merges:
    """The merges of a vocabulary file: token ids of bytes, and pair keys in order with rank and product."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.byte_ids = np.array([vocab[s] for s in byte_symbols()], np.int32)
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.left, self.right = left, right
        self.product = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left << 32 | right
        self.by_key = np.argsort(key, kind="stable")
        self.keys = key[self.by_key]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, -1 where there is none."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], -1)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and where each word begins (with the end)."""
        sizes = np.fromiter((len(w) for w in words), np.int64, len(words))
        return self.replay_flat(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum(sizes)]))

    def replay_flat(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``replay`` of words whose bytes lie end to end, given where each begins (with the end).

        A worker's memory is mostly what a byte takes here: 13 bytes for its
        token, links and mark, and while the first pairs are indexed 16 more.
        """
        total = int(starts[-1])
        kind = np.int32 if total < 2**31 - 1 else np.int64
        token = np.empty(total + 1, np.int32)
        token[:total] = self.byte_ids[text]
        token[total] = -1
        # Links to the neighbours in a word; position `total` stands for none.
        ahead = np.arange(1, total + 2, dtype=kind)
        ahead[np.maximum(starts[1:] - 1, 0)] = total
        ahead[total] = total
        back = np.arange(-1, total, dtype=kind)
        back[starts[:-1]] = total
        back[back < 0] = total
        alive = np.ones(total + 1, bool)
        alive[total] = False
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def ranked(at: np.ndarray) -> np.ndarray:
            """The pairs that begin at these positions and merge: rank and position in one number."""
            at = at[ahead[at] != total]
            rank = self.ranks(token[at], token[ahead[at]])
            good = rank >= 0
            return rank[good] << PLACE | at[good]

        def enter(pairs: np.ndarray) -> None:
            """Index pairs by rank; their numbers are used up."""
            if not len(pairs):
                return
            pairs.sort()
            rank = (pairs >> PLACE).astype(np.int32)
            pairs &= (1 << PLACE) - 1
            at = pairs.astype(kind)
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(queue, r)

        enter(np.concatenate([ranked(np.arange(i, min(i + SPAN, total), dtype=kind)) for i in range(0, total, SPAN)] or [np.empty(0, np.int64)]))
        while queue:
            r = heapq.heappop(queue)
            parts = index.pop(r)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            a, b = self.left[r], self.right[r]
            at = at[alive[at] & (token[at] == a) & (token[ahead[at]] == b)]
            if a == b and len(at) > 1:
                # Of overlapping pairs in a row of equal tokens, every other one from the left.
                at = np.unique(at)
                linked = np.concatenate([[False], ahead[at[:-1]] == at[1:]])
                place = np.arange(len(at))
                head = np.maximum.accumulate(np.where(linked, 0, place))
                at = at[(place - head) % 2 == 0]
            if not len(at):
                continue
            gone = ahead[at]
            token[at] = self.product[r]
            alive[gone] = False
            after = ahead[gone]
            ahead[at] = after
            inner = after != total
            back[after[inner]] = at[inner]
            prior = back[at]
            enter(ranked(np.unique(np.concatenate([at, prior[prior != total]]))))
        left = np.zeros(total + 1, kind)
        np.cumsum(alive[:total], dtype=kind, out=left[1:])
        return token[:total][alive[:total]], left[starts].astype(np.int64)


def flat_words(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings end to end and where each begins (with the end)."""
    _, ends, text = words.buffers()
    kind = np.int64 if pa.types.is_large_string(words.type) else np.int32
    starts = np.frombuffer(ends, kind)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(text or b"", np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def number_words(texts: list[str | None], split) -> tuple[list[str], list[np.ndarray]]:
    """The distinct words of some texts, and each text as numbers of words."""
    number: dict[str, int] = {}
    coded = []
    for text in texts:
        words = split(text) if text else ()
        coded.append(np.fromiter([number.setdefault(w, len(number)) for w in words], np.int32, len(words)))
    return list(number), coded


def read_off(codes: np.ndarray, edges: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end and where each begins (with the end), from word numbers and the words' ids."""
    begin = starts[codes]
    sizes = starts[codes + 1] - begin
    ends = np.cumsum(sizes)
    gather = np.repeat(begin - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
    return ids[gather], np.concatenate([[0], ends])[edges]


class Encoder:
    """Encodes texts in one process."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import regex

        self.merges, self.split = Merges(path), regex.compile(pattern).findall

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text begins (with the end)."""
        words, coded = number_words(texts, self.split)
        ids, starts = self.merges.replay([w.encode("utf-8") for w in words]) if words else (np.empty(0, np.int32), np.zeros(1, np.int64))
        edges = np.concatenate([[0], np.cumsum([len(c) for c in coded], dtype=np.int64)])
        return read_off(np.concatenate([*coded, np.empty(0, np.int32)]), edges, ids, starts)


def stretches(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Spans of texts of about ``most`` characters together, at least one text each."""
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= most:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode_corpus(df: DataFrame, text: str, out: str = "ids", vocabulary: str = VOCABULARY, sizes_only: bool = False, stretch: int = 250_000, heap: int = 4_000_000) -> DataFrame:
    """Replace the text column by its token ids, or by their number with ``sizes_only``.

    Other columns are kept, but for one named ``out``. ``vocabulary`` is a
    tokenizer file that every executor can read. A stretch has about
    ``stretch`` characters; words of about ``heap`` characters are replayed at
    once.
    """
    keep = [c for c in df.columns if c not in (text, out)]
    held = [f"k{i}" for i in range(len(keep))]
    kinds = dict(df.dtypes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each word of a stretch, then one for each of its texts."""
        import regex
        from pyspark import TaskContext

        split = regex.compile(PATTERN).findall
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in stretches(texts, stretch):
                words, coded = number_words(texts[a:b], split)
                edges = np.concatenate([[0], np.cumsum([len(c) for c in coded], dtype=np.int64)])
                codes = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(coded), pa.int32()))
                own = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                for n, *columns in (
                    (len(words), *(pa.nulls(len(words), c.type) for c in own), pa.array(np.arange(len(words)), pa.int32()), pa.array(words, pa.string()), pa.nulls(len(words), codes.type)),
                    (b - a, *own, pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.string()), codes),
                ):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number, np.int64)), *columns], ["stretch", *held, "code", "word", "codes"])
                number += 1

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, waiting, size = None, [], 0

        def give() -> pa.RecordBatch:
            words = pa.chunked_array(waiting).combine_chunks()
            waiting.clear()
            ids, starts = merges.replay_flat(*flat_words(words))
            made = pa.array(np.diff(starts), pa.int32()) if sizes_only else pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
            return pa.RecordBatch.from_arrays([words, made], ["word", "ids"])

        for batch in batches:
            if not batch.num_rows:
                continue
            merges = merges or Merges(vocabulary)
            waiting.append(batch.column(0))
            size += batch.column(0).nbytes
            if size >= heap:
                yield give()
                size = 0
        if waiting:
            yield give()

    def apply(known: pa.Table, texts: pa.Table) -> pa.Table:
        """The texts of a stretch with their ids, from the (code, ids) of its words in any order."""
        codes = texts["codes"].combine_chunks()
        edges = codes.offsets.to_numpy()
        edges = edges - edges[0]
        flat = codes.flatten().to_numpy()
        place = pa.array(np.argsort(known["code"].to_numpy(), kind="stable"), pa.int64())
        ids = known["ids"].combine_chunks().take(place)
        if sizes_only:
            sums = np.concatenate([[0], np.cumsum(ids.to_numpy()[flat], dtype=np.int64)])
            made = pa.array(np.diff(sums[edges]), pa.int64())
        else:
            got, begins = read_off(flat, edges, ids.flatten().to_numpy(), ids.offsets.to_numpy().astype(np.int64))
            made = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(got, pa.int32()))
        return pa.Table.from_arrays([*(texts[h] for h in held), made], [*keep, out])

    plain = df.select(*keep, text)
    rows = plain.mapInArrow(cut, ", ".join(["stretch bigint", *(f"{h} {kinds[c]}" for h, c in zip(held, keep)), "code int, word string, codes array<int>"]))
    table, _ = store(rows, "stretches")
    uses = table.filter(F.col("word").isNotNull()).select("stretch", "code", "word")
    encoded, _ = store(uses.select("word").distinct().mapInArrow(replay, f"word string, ids {'int' if sizes_only else 'array<int>'}"), "words")
    known = uses.join(encoded, "word").select("stretch", "code", "ids")
    texts = table.filter(F.col("word").isNull()).select(F.col("stretch").alias("part"), *held, "codes")
    fields = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{out}` {'bigint' if sizes_only else 'array<int>'}"])
    return known.groupBy("stretch").cogroup(texts.groupBy("part")).applyInArrow(apply, fields)
