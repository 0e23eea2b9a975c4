"""N-best SentencePiece segmentation and decoding.

A text is one piece lattice.  Forward Viterbi gives every node its best score from the start, which is the exact
heuristic of an A-star search that walks backward from the end and so meets complete segmentations best first.

No piece of the vocabulary has a blank mark behind another character (checked when it is loaded), and none has a line
break, so the lattice falls apart at those places into chunks.  Every distinct chunk gets its forward and backward Viterbi scores once,
which give its best path and the loss of its second best.  Of a text's chunks only the n - 1 with the smallest such losses can differ
from their best path in the n best segmentations of the text; A-star lists the paths of those, and a heap merges them.

Scores are those of the model: a segmentation's score is the sum over its pieces.  A character without a piece goes over an edge
that scores ``FALLBACK`` below the worst piece, and becomes its UTF-8 byte pieces.  Of equally good paths that whose last pieces are longest wins.

Defined cases: null and empty texts have no pieces, one segmentation of score 0 and decode to the empty text; a literal
blank mark U+2581 becomes a blank, as in the vocabulary's own library, so such texts do not come back as they were; very
long texts are read whole; repeated rows give one result each; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ODD, Grown, kept, ranges

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK, FALLBACK, NONE = "▁", 10.0, -1e30
#: Scores at or below this mark pieces that no merge of the model makes (blank marks); they score like the fallback.
UNUSED = -1e8
#: A memo of chunks is emptied when it holds this many, so its memory is bounded; results do not depend on it.
MEMO_CHUNKS = 200_000
#: Texts of about so many characters are solved together; chunks above ``LONG`` characters one by one.
GROUP_CHARS, LONG = 1_000_000, 64
CHUNKS = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


class Prefixes:
    """All beginnings of pieces as numbered nodes, and which character leads from one to the next, in a table that arrays
    of nodes look up at once.  Slots are probed one after the other, so different keys never pass for each other."""

    BITS, END = 19, 0x1FFFFF

    def __init__(self, begins: Iterable[str], numbers: dict[str, int]):
        node = {"": 0} | {p: i for i, p in enumerate(begins, 1)}
        self.bits = max(self.BITS, (4 * len(node)).bit_length())
        self.longest = max(map(len, node))
        self.number = np.full(len(node), -1, np.int64)
        self.number[[node[p] for p in numbers]] = [*numbers.values()]
        self.key, self.next = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        keys = np.array([node[p[:-1]] << 21 | ord(p[-1]) for p in node if p], np.int64)
        for key, slot, to in zip(keys.tolist(), self.slots(keys).tolist(), range(1, len(node))):
            while self.key[slot] != -1:
                slot = slot + 1 & (1 << self.bits) - 1
            self.key[slot], self.next[slot] = key, to

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * ODD) >> np.uint64(64 - self.bits)).view(np.int64)

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The node behind each node by a character, -1 where none is."""
        keys = nodes << 21 | codes
        slots = self.slots(keys)
        held = self.key[slots]
        out = np.where(held == keys, self.next[slots], -1)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        while len(open_):
            slots[open_] = slots[open_] + 1 & (1 << self.bits) - 1
            held = self.key[slots[open_]]
            same = held == keys[open_]
            out[open_[same]] = self.next[slots[open_[same]]]
            open_ = open_[~same & (held != -1)]
        return out

    def found(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every piece at every place of a text: (starts, stops, numbers)."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        codes = np.r_[codes, self.END]
        at, nodes, out = np.arange(len(text)), np.zeros(len(text), np.int64), []
        for length in range(1, self.longest + 1):
            nodes = self.step(nodes, codes[at + length - 1])
            more = np.flatnonzero(nodes >= 0)
            at, nodes = at[more], nodes[more]
            number = self.number[nodes]
            whole = np.flatnonzero(number >= 0)
            out.append((at[whole], at[whole] + length, number[whole]))
        return tuple(map(np.concatenate, zip(*out)))


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=os.fspath(path))
        size = model.vocab_size()
        self.score, self.id, self.byte = {}, {}, [0] * 256
        self.bytes: list[bytes] = [b""] * size
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte[value], self.bytes[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.score[piece], self.id[piece] = model.get_score(i), i
                self.bytes[i] = piece.replace(MARK, " ").encode("utf-8")
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.id):
            raise ValueError("the vocabulary has pieces across words or lines")
        self.unknown = min(s for s in self.score.values() if s > UNUSED) - FALLBACK
        self.score = {p: s if s > UNUSED else self.unknown for p, s in self.score.items()}
        # Pieces go by number; the last number is a character's fallback.
        self.piece_score = np.array([*self.score.values(), self.unknown])
        self.piece_id = np.array([*(self.id[p] for p in self.score), -1], np.int32)
        self.byte_id = np.array(self.byte, np.int32)
        #: The score of every piece, and ``NONE`` for what only begins longer pieces.
        self.begins = {p[:n]: NONE for p in self.score for n in range(1, len(p))} | self.score
        self.prefixes = Prefixes(self.begins, {p: i for i, p in enumerate(self.score)})

    def ids(self, pieces: list[str]) -> list[int]:
        """A path's ids; characters without a piece become byte pieces."""
        out: list[int] = []
        for piece in pieces:
            known = self.id.get(piece)
            out += [known] if known is not None else [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]
        return out

    def decode(self, ids) -> str:
        """The text of ids, without the blank that encoding puts in front."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")[1:]


def lattice(chunk: str, words: Vocabulary) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Forward Viterbi: each node's best score, and all edges in the order of their starts."""
    n, get, unknown = len(chunk), words.begins.get, words.unknown
    forward, edges = [0.0] + [NONE] * n, []
    for i in range(n):
        at = forward[i]
        for j in range(i + 1, n + 1):
            s = get(chunk[i:j])
            if s is None or s == NONE:
                if j == i + 1:
                    edges.append((i, j, unknown))
                    forward[j] = max(forward[j], at + unknown)
                if s is None:
                    break
                continue
            edges.append((i, j, s))
            forward[j] = max(forward[j], at + s)
    return forward, edges


def search(chunk: str, words: Vocabulary, count: int) -> list[tuple[float, list[str]]]:
    """The ``count`` best segmentations, best first: A-star from the end, whose estimate of what is left is exact."""
    forward, edges = lattice(chunk, words)
    into: list[list] = [[] for _ in range(len(chunk) + 1)]
    for i, j, s in edges:
        into[j].append((i, s))
    heap, found, serial = [(-forward[-1], len(chunk), 0, 0.0, None)], [], 0
    while heap and len(found) < count:
        _, at, _, behind, path = heapq.heappop(heap)
        if at == 0:
            pieces, start = [], 0
            while path:
                stop, path = path
                pieces.append(chunk[start:stop])
                start = stop
            found.append((behind, pieces))
            continue
        for i, s in into[at]:
            serial += 1
            heapq.heappush(heap, (-(forward[i] + s + behind), i, serial, s + behind, (at, path)))
    return found


def best_and_loss(chunk: str, words: Vocabulary) -> tuple[float, list[str], float]:
    """The best score and path, and how much worse the second-best path is (infinite if there is none): forward Viterbi
    that keeps the two best scores of every node."""
    n, get, unknown = len(chunk), words.begins.get, words.unknown
    best, second, back = [0.0] + [NONE] * n, [NONE] * (n + 1), [0] * (n + 1)
    for i in range(n):
        at, less = best[i], second[i]
        for j in range(i + 1, n + 1):
            s = get(chunk[i:j])
            if s is None or s == NONE:
                if j > i + 1:
                    if s is None:
                        break
                    continue
                known, s = s, unknown
            else:
                known = s
            v, f = at + s, best[j]
            if v > f:
                best[j], back[j] = v, i
                second[j] = f if f > less + s else less + s
            elif v > second[j]:
                second[j] = v
            if known is None:
                break
    pieces, at = [], n
    while at:
        pieces.append(chunk[back[at]:at])
        at = back[at]
    return best[n], pieces[::-1], best[n] - second[n] if second[n] > NONE / 2 else float("inf")


@kept
@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Loaded once for each Python worker, which runs many tasks."""
    return Vocabulary(path)


@kept
@functools.lru_cache(maxsize=1)
def known_chunks(path: str) -> "Chunks":
    """A Python worker's memo, which outlives a task: most words of a task were met in those before it."""
    return Chunks(vocabulary(path))


def solved_at_once(chunks: list[str], words: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``best_and_loss`` gives, of many short chunks: (best scores, losses, all ids one after the other, how many of them each
    chunk has).  The table of prefixes finds the edges of all lattices, and each step of forward Viterbi takes one depth of all chunks."""
    text = "\n".join(chunks)
    lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
    # Node p stands before character p of the joined text; a chunk's last node falls on the line break behind it.
    last = np.cumsum(lengths + 1) - 1
    first = last - lengths
    nodes = len(text) + 1
    start, stop, piece = words.prefixes.found(text)
    alone = np.ones(nodes, bool)
    alone[last], alone[start[stop - start == 1]] = False, False
    alone = np.flatnonzero(alone)
    start, stop, piece = np.r_[start, alone], np.r_[stop, alone + 1], np.r_[piece, np.full(len(alone), len(words.piece_id) - 1)]
    depth = np.arange(nodes) - np.repeat(first, lengths + 1)
    order = np.lexsort((start, stop, depth[stop]))
    start, stop, piece = start[order], stop[order], piece[order]
    score = words.piece_score[piece]
    best, second, back = np.full(nodes, NONE), np.full(nodes, NONE), np.zeros(nodes, np.int64)
    best[first] = 0.0
    levels = np.searchsorted(depth[stop], np.arange(1, int(lengths.max()) + 2))
    for low, high in itertools.pairwise(levels.tolist()):
        target = stop[low:high]
        group = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        size = np.diff(np.r_[group, high - low])
        value = best[start[low:high]] + score[low:high]
        top = np.maximum.reduceat(value, group)
        # Of equal values the first, which has the longest last piece, is the best one; the others compete for the second place.
        equal = np.flatnonzero(value == np.repeat(top, size))
        chosen = equal[np.unique(np.repeat(np.arange(len(group)), size)[equal], return_index=True)[1]]
        value[chosen] = second[start[low + chosen]] + score[low + chosen]
        at = target[group]
        best[at], second[at], back[at] = top, np.maximum.reduceat(value, group), low + chosen
    owner, now, steps = np.arange(len(chunks)), last, []
    while len(owner):
        edge = back[now]
        steps.append((owner, edge))
        now = start[edge]
        more = now > first[owner]
        owner, now = owner[more], now[more]
    owner, edge = (np.concatenate(x)[::-1] for x in zip(*steps))
    order = np.argsort(owner, kind="stable")
    owner, edge = owner[order], edge[order]
    ids, count = words.piece_id[piece[edge]], np.ones(len(edge), np.int64)
    bare = np.flatnonzero(ids < 0)
    data = [text[at].encode("utf-8", "surrogatepass") for at in start[edge[bare]].tolist()]
    count[bare] = np.fromiter(map(len, data), np.int64, len(data))
    ids, at = np.repeat(ids, count), np.cumsum(count) - count
    ids[ranges(at[bare], count[bare])] = words.byte_id[np.frombuffer(b"".join(data), np.uint8)]
    loss = np.where(second[last] > NONE / 2, best[last] - second[last], np.inf)
    return best[last], loss, ids, np.bincount(owner, count, len(chunks)).astype(np.int64)


class Chunks:
    """The best path, score and loss of every distinct chunk met so far."""

    def __init__(self, words: Vocabulary):
        self.words = words
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.start, self.length = Grown(np.int32), Grown(np.int64), Grown(np.int64)
        self.best, self.loss = Grown(np.float64), Grown(np.float64)

    def add(self, chunks: list[str]) -> None:
        short = [c for c in chunks if len(c) <= LONG]
        if short:
            self.keep(short, *solved_at_once(short, self.words))
        for chunk in (c for c in chunks if len(c) > LONG):
            best, pieces, loss = best_and_loss(chunk, self.words)
            ids = self.words.ids(pieces)
            self.keep([chunk], [best], [loss], ids, np.array([len(ids)]))

    def keep(self, chunks: list[str], best, loss, ids, lengths: np.ndarray) -> None:
        self.start.add(self.ids.size + np.cumsum(lengths) - lengths)
        self.length.add(lengths)
        self.ids.add(ids)
        self.best.add(best)
        self.loss.add(loss)
        self.number.update(zip(chunks, range(len(self.number), len(self.number) + len(chunks))))

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """The numbers hold until the next call, which may empty the memo."""
        new = [c for c in dict.fromkeys(chunks) if c not in self.number]
        if new and len(self.number) + len(new) > MEMO_CHUNKS:
            self.clear()
            new = [*dict.fromkeys(chunks)]
        if new:
            self.add(new)
        return np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))


def chunked(text: str | None) -> list[str]:
    return CHUNKS.findall(MARK + text.replace(" ", MARK)) if text else []


def n_best(text: str | None, known: Chunks, count: int) -> tuple[np.ndarray, list[tuple[float, list[tuple[int, list[int]]]]]]:
    """The ids of the best segmentation, and for each of the ``count`` best its score and its changes to the best: chunk
    number and the chunk's other ids."""
    return next(n_best_of_all([text], known, count))


def n_best_of_all(texts: Iterable[str | None], known: Chunks, count: int) -> Iterator[tuple]:
    """``n_best`` of each text; the new chunks of texts of ``GROUP_CHARS`` characters are solved at once."""
    group, room = [], GROUP_CHARS
    for text in texts:
        group.append(chunked(text))
        room -= len(text or "")
        if room <= 0:
            yield from n_best_of_group(group, known, count)
            group, room = [], GROUP_CHARS
    yield from n_best_of_group(group, known, count)


def n_best_of_group(group: list[list[str]], known: Chunks, count: int) -> Iterator[tuple]:
    numbers, at = known.numbers(list(itertools.chain.from_iterable(group))), 0
    for chunks in group:
        yield best_paths(chunks, numbers[at:at + len(chunks)], known, count)
        at += len(chunks)


def best_paths(chunks: list[str], numbers: np.ndarray, known: Chunks, count: int) -> tuple:
    if not chunks:
        return np.empty(0, np.int32), [(0.0, [])]
    ids = known.ids[ranges(known.start[numbers], known.length[numbers])]
    best, losses = float(known.best[numbers].sum()), known.loss[numbers]
    if count == 1:
        return ids, [(best, [])]
    few = np.argsort(losses, kind="stable")[:count - 1] if len(losses) <= 4 * count else \
        (part := np.sort(np.flatnonzero(losses <= np.partition(losses, count - 2)[count - 2])))[np.argsort(losses[part], kind="stable")][:count - 1]
    few = [int(at) for at in few if np.isfinite(losses[at])]
    paths = {at: search(chunks[at], known.words, count) for at in few}
    # Every state names one path for each chunk, by rank; a state is reached by raising the last rank raised or a later one.
    heap, out = [(0.0, (), ())], []
    while heap and len(out) < count:
        lost, _, ranks = heapq.heappop(heap)
        out.append((best - lost, [(few[k], known.words.ids(paths[few[k]][r][1])) for k, r in ranks]))
        last, rank = ranks[-1] if ranks else (-1, 0)
        for k in range(max(last, 0), len(few)):
            r = rank + 1 if k == last else 1
            options = paths[few[k]]
            if r < len(options):
                state = (ranks[:-1] if k == last else ranks) + ((k, r),)
                base = options[r - 1][0] if k == last else options[0][0]
                heapq.heappush(heap, (lost + base - options[r][0], state, state))
    return ids, out


CHANGES = "array<struct<chunk:int, ids:array<int>>>"
ENCODED = f"doc_id bigint, ids array<int>, segmentations array<struct<score:double, changes:{CHANGES}>>"
DIGESTS = ("doc_id bigint, n_pieces bigint, ids_sha256 string, best_score double, n_found int, nth_score double, "
           "nth_changes string, round_trip boolean")


def encoder(path: str, count: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_chunks(path)
        change = pa.struct([("chunk", pa.int32()), ("ids", pa.list_(pa.int32()))])
        kind = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(change))]))
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                rows = list(n_best_of_all(batch.column("text")[i:i + 64].to_pylist(), known, count))
                found = [[{"score": s, "changes": [{"chunk": at, "ids": x} for at, x in c]} for s, c in r[1]] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:i + 64], pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array(found, kind)],
                    ["doc_id", "ids", "segmentations"])

    return encode


def digester(path: str, count: int):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_chunks(path)
        for batch in batches:
            rows = []
            texts = (t.as_py() or "" for t in batch.column("text"))
            ahead, texts = itertools.tee(texts)
            for doc_id, text, (ids, found) in zip(batch.column("doc_id").to_pylist(), texts, n_best_of_all(ahead, known, count)):
                score, changes = found[-1]
                rows.append({"doc_id": doc_id, "n_pieces": len(ids), "ids_sha256": hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(),
                             "best_score": found[0][0], "n_found": len(found), "nth_score": score, "nth_changes": str(changes),
                             "round_trip": known.words.decode(ids.tolist()) == text})
            yield pa.RecordBatch.from_pylist(rows, pa.schema(
                [("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_sha256", pa.string()), ("best_score", pa.float64()),
                 ("n_found", pa.int32()), ("nth_score", pa.float64()), ("nth_changes", pa.string()), ("round_trip", pa.bool_())]))

    return digest


def decoder(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([words.decode(x.as_py() or []) for x in batch.column("ids")], pa.string())],
                ["doc_id", "text"])

    return decode


def read(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), "text")


def encode(documents: DataFrame, count: int = 4, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, segmentations): the best segmentation's ids, and the ``count`` best by score with their changes."""
    return read(documents).mapInArrow(encoder(path, count), ENCODED)


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(decoder(path), "doc_id bigint, text string")


def encode_digests(documents: DataFrame, count: int = 4, path: str = VOCABULARY) -> DataFrame:
    """What ``encode`` finds as digests, and whether decoding gives the text back."""
    return read(documents).mapInArrow(digester(path, count), DIGESTS)
