"""SentencePiece encoding and decoding with a streaming Viterbi.

The best segmentation maximises the sum of the piece scores; a character that no piece covers falls
back to its UTF-8 bytes at a cost below every piece.  The encoder reads from left to right and keeps
a window: the boundaries from which a piece may still run on, never more than the longest piece has
characters, each with its best path.  Ids are committed up to the boundary on which all surviving
paths converge.  ``Window`` does so character by character; ``lockstep`` does the same for many
blocks at once, and a block's ids count only if its paths were found to have met at its end.  What
follows a commit does not depend on what lies before, so solved blocks are remembered.

Memory follows the undecided part of a text, not its length, and a bounded number of remembered
blocks.  Text is prefixed with one space, spaces stand for U+2581, nothing else is changed; a literal
U+2581 is encoded as bytes.  ``decode(encode(text)) == text`` for every text.  Each document is
independent: one map-only stage.

Defined results: a null text has null ids and decodes to null; an empty text has no ids; repeated
rows encode alike; added columns replace ones of the same name.  The model file is a parameter, read
on the driver and shipped as its pieces (a fixed size).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded, with_fields

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_NEVER = float("-inf")
UNIT = 1e6  # scores are whole millionths, so sums and ties do not depend on where a text was committed
MEMO, MEMO_LENGTH = 200_000, 64  # remembered blocks per Python worker, and their longest
DOUBLING = 32  # pieces from which on an undecided part is looked through only when it has doubled
BLOCK_STARTS = " \n"  # every block of ``_BLOCK`` starts with one of these, unless after a line feed
_M1 = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = re.compile(r" *[^ \n]+| +|\n")  # how far to read at once; decides nothing about ids


def load(path: str = MODEL, scores: str = "zipf") -> dict:
    """The pieces of a model file: text -> (id, score), byte ids, and id -> text or byte.

    A merge model's file has no probabilities: its scores are the ranks of the merges, negated.
    ``scores="zipf"`` turns rank r into the log probability of a Zipf-Mandelbrot law, 1 / (r + 2.7)
    over their sum; ``scores="file"`` takes the numbers of the file as they are (right for files of
    unigram models)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, by_byte, texts = {}, {}, []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            by_byte[int(piece[3:5], 16)] = i
            texts.append(None)
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            texts.append("")
        else:
            pieces[piece] = (i, sp.get_score(i))
            texts.append(piece)
    if len(by_byte) != 256:
        raise ValueError("the model has no byte fallback; texts would not round-trip")
    if scores == "zipf":
        total = math.log(sum(1 / (2.7 - s) for _, s in pieces.values()))
        pieces = {p: (i, -math.log(2.7 - s) - total) for p, (i, s) in pieces.items()}
    elif scores != "file":
        raise ValueError(f"unknown scores {scores}")
    return {"pieces": {p: (i, float(round(s * UNIT))) for p, (i, s) in pieces.items()}, "bytes": by_byte, "texts": texts}


class Window:
    """Reads one character at a time and keeps the boundaries from which a piece may still run on
    (never more than the longest piece has characters), each with its best path, a chain of
    [id, path before, length].  Ids are committed where all these paths meet: looked for when at most
    two boundaries are left, and whenever the undecided part has doubled, so work stays linear."""

    def __init__(self, codec: Codec):
        self.codec, self.root = codec, [0, None, 0]
        self.live: list = [(codec.trie, 0.0, self.root)]  # trie below the open piece, score, path
        self.due = DOUBLING

    def read(self, char: str) -> tuple:
        """The ids committed after one more character; ties of scores go to the longest piece."""
        trie, after, best, single = self.codec.trie, [], _NEVER, False
        for below, score, path in self.live:
            node = below.get(char)
            if node is None:
                continue
            piece, gain, deeper = node
            if piece >= 0:
                single = below is trie
                if score + gain > best:
                    best, before, last = score + gain, path, piece
            if deeper:
                after.append((deeper, score, path))
        newest = self.live[-1]
        if not single and newest[1] + self.codec.fallback > best:  # its bytes, by the negative code point
            best, before, last = newest[1] + self.codec.fallback, newest[2], -ord(char) - 1
        after.append((trie, best, [last, before, before[2] + 1]))
        self.live = after
        return self.commit() if len(after) <= 2 or after[-1][2][2] - self.root[2] >= self.due else ()

    def commit(self) -> tuple:
        """The ids from the last commit to where all paths meet."""
        ends = {id(path): path for _, _, path in self.live}
        while len(ends) > 1:
            _, far = max((path[2], at) for at, path in ends.items())
            before = ends.pop(far)[1]
            ends[id(before)] = before
        meet = ends.popitem()[1]
        ids, at = [], meet
        while at is not self.root:
            ids.append(at[0])
            at = at[1]
        meet[1], self.root = None, meet  # what lies before is given up
        self.due = max(DOUBLING, 2 * (self.live[-1][2][2] - meet[2]))
        return self.codec.spell(reversed(ids))

    def close(self) -> tuple:
        """The ids after the last commit: only the end of the text is left."""
        self.live = self.live[-1:]
        return self.commit()


class Codec:
    def __init__(self, model: dict):
        self.pieces, self.texts = model["pieces"], model["texts"]
        self.bytes = model["bytes"]
        self.value = {i: b for b, i in self.bytes.items()}
        self.plain = [None if t is None else t.replace(MARK, " ") for t in self.texts]
        self.fallback = min(s for _, s in self.pieces.values()) - 10 * UNIT
        self.trie: dict = {}  # character -> (id or -1, score, children); pieces with spaces as spaces
        for piece, (i, score) in sorted(self.pieces.items()):
            children, piece = self.trie, piece.replace(MARK, " ")
            for c in piece[:-1]:
                children = children.setdefault(c, (-1, 0.0, {}))[2]
            below = children[piece[-1]][2] if piece[-1] in children else {}
            children[piece[-1]] = (i, score, below)
        # per length, the hashes of all starts of pieces of that length: id or -1, score, any longer
        seen: list[dict[int, list]] = [{} for _ in range(max(map(len, self.pieces)))]
        for piece, (i, score) in self.pieces.items():
            h = 0
            for n, c in enumerate(piece.replace(MARK, " ")):
                h = (h * int(_M1) + ord(c)) % 2**64
                entry = seen[n].setdefault(h, [-1, 0.0, False])
                if n == len(piece) - 1:
                    entry[0], entry[1] = i, score
                else:
                    entry[2] = True
        self.levels = []
        for level in seen:
            rows = sorted(level.items())
            self.levels.append((np.array([h for h, _ in rows], np.uint64), np.array([e[0] for _, e in rows], np.int64),
                                np.array([e[1] for _, e in rows]), np.array([e[2] for _, e in rows], bool)))
        self.memo: dict[str, tuple | None] = {}

    def _bytes(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()]

    def spell(self, path: Iterable[int]) -> tuple:
        return tuple(y for x in path for y in ((x,) if x >= 0 else self._bytes(chr(-x - 1))))

    def stream(self, chars: Iterable[str]) -> Iterator[tuple]:
        """Committed ids of a text that arrives in characters or longer parts, in order."""
        window, begun = Window(self), False
        for part in chars:
            for c in part if begun or not part else " " + part:
                begun = True
                ids = window.read(c)
                if ids:
                    yield ids
        if begun:
            yield window.close()

    def lockstep(self, blocks: list[str]) -> list[tuple | None]:
        """``Window`` for many blocks at once, on arrays: the ids of each block if all its paths meet at
        its end whatever block follows, else None.

        A boundary survives the end of a block if the characters from it on, with the first one of
        the next block, begin a piece; if none does, the end itself is the one boundary left."""
        lengths = np.array([len(t) for t in blocks])
        codes = np.frombuffer("".join(blocks).encode("utf-32-le"), np.uint32).astype(np.uint64)
        word = np.repeat(np.arange(len(blocks)), lengths)
        head = np.cumsum(lengths) - lengths
        place = np.arange(len(codes)) - head[word]
        left = lengths[word] - place
        boundary = np.arange(len(codes)) + word  # of each character's start: a block has one more
        edges = []  # length, start boundaries by place, ids, scores, and where each place begins
        alive, h, single = np.arange(len(codes)), np.zeros(len(codes), np.uint64), np.zeros(len(codes), bool)
        open_ = np.zeros(len(blocks), bool)
        for n, (keys, ids, scores, more) in enumerate(self.levels, 1):
            fits = left[alive] >= n
            alive, h = alive[fits], h[fits]
            h = h * _M1 + codes[alive + (n - 1)]
            row = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            known = keys[row] == h
            alive, h, row = alive[known], h[known], row[known]
            piece = ids[row] >= 0
            at, own, gain = alive[piece], ids[row[piece]], scores[row[piece]]
            if n == 1:  # bytes where no piece covers a character, marked by a negative code point
                single[at] = True
                bare = np.flatnonzero(~single)
                at, own = np.concatenate([at, bare]), np.concatenate([own, -codes[bare].astype(np.int64) - 1])
                gain = np.concatenate([gain, np.full(len(bare), self.fallback)])
            order = np.argsort(place[at], kind="stable")
            at = at[order]
            edges.append((n, boundary[at], own[order], gain[order], np.searchsorted(place[at], np.arange(lengths.max() + 1))))
            alive, h = alive[more[row]], h[more[row]]
            tail = np.flatnonzero(left[alive] == n)  # a piece is open at the end of the block
            if len(tail):
                at, after = alive[tail], self.levels[n][0]
                goes = codes[at + (n - 1)] == 10  # any character follows a line feed
                for first in BLOCK_STARTS:
                    ahead = h[tail] * _M1 + np.uint64(ord(first))
                    goes |= after[np.minimum(np.searchsorted(after, ahead), len(after) - 1)] == ahead
                open_[word[at[goes]]] = True
        best = np.full(len(codes) + len(blocks), _NEVER)
        head += np.arange(len(blocks))
        best[head] = 0.0
        back, last = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64)
        for p in range(int(lengths.max())):
            for n, start, own, gain, cut in edges:
                a, z = cut[p], cut[p + 1]
                if a == z:
                    continue
                score = best[start[a:z]] + gain[a:z]
                goal = start[a:z] + n
                better = np.flatnonzero(score > best[goal])
                goal = goal[better]
                best[goal], back[goal], last[goal] = score[better], n, own[a:z][better]
        first = head
        at, who, found, owner = first + lengths, np.arange(len(blocks)), [], []
        while len(at):
            found.append(last[at])
            owner.append(who)
            at = at - back[at]
            going = at != first[who]
            at, who = at[going], who[going]
        owner = np.concatenate(owner[::-1])
        order = np.argsort(owner, kind="stable")
        ids = np.concatenate(found[::-1])[order].tolist()
        ends = np.cumsum(np.bincount(owner, minlength=len(blocks))).tolist()
        out = [ids[a:z] for a, z in zip([0, *ends], ends, strict=False)]
        return [None if o else tuple(x) if min(x) >= 0 else self.spell(x) for x, o in zip(out, open_.tolist(), strict=True)]

    def encode_all(self, texts: list[str | None]) -> list[list[int] | None]:
        """Ids of each text.  Texts are read in blocks.  Where the paths of a block meet by its end, its
        ids are final; all new blocks of the texts are solved at once and remembered.  From a block
        where they do not meet, or a long one, the rest is read character by character."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        split = [None if t is None else _BLOCK.findall(" " + t) if t else [] for t in texts]
        unseen = set(chain.from_iterable(blocks for blocks in split if blocks)).difference(memo)
        new = [b for b in unseen if len(b) <= MEMO_LENGTH]
        if new:
            memo.update(zip(new, self.lockstep(new), strict=True))
        out: list[list[int] | None] = []
        for t, blocks in zip(texts, split, strict=True):
            known = [*map(memo.get, blocks or ())]
            if None in known:
                first = known.index(None)
                window = Window(self)
                rest = map(window.read, (" " + t)[sum(map(len, blocks[:first])):])
                known[first:] = [*filter(None, rest), window.close()]
            out.append(None if blocks is None else [*chain.from_iterable(known)])
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        plain = self.plain
        try:
            return "".join([plain[i] for i in ids])[1:]
        except TypeError:  # byte pieces
            parts, run = [], bytearray()
            for i in ids:
                if plain[i] is None:
                    run.append(self.value[i])
                else:
                    if run:
                        parts.append(run.decode("utf-8", "replace"))
                        run.clear()
                    parts.append(plain[i])
            parts.append(run.decode("utf-8", "replace"))
            return "".join(parts)[1:]


def _map(df: DataFrame, model: dict, column: str, added: list[tuple[str, str]], work) -> DataFrame:
    if column in [n for n, _ in added]:
        raise ValueError(f"the added column {column} would replace the one it is made from")
    df = df.drop(*[n for n, _ in added])
    shared = df.sparkSession.sparkContext.broadcast(model)  # the vocabulary: a fixed size
    at, names = df.columns.index(column), [*df.columns, *[n for n, _ in added]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):  # bounds the ids held at once
                batch = whole.slice(start, 256)
                yield pa.RecordBatch.from_arrays([*batch.columns, *work(codec, batch.column(at).to_pylist())], names=names)

    return df.transform(bounded).mapInArrow(run, with_fields(df.schema, **dict(added)))


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", check_col: str | None = None, model_path: str = MODEL,
           scores: str = "zipf") -> DataFrame:
    """``df`` with the ids of each text and, if named, whether they decode to it again."""
    check = check_col is not None

    def work(codec: Codec, texts: list[str | None]) -> list[pa.Array]:
        coded = codec.encode_all(texts)
        lengths = [0 if c is None else len(c) for c in coded]
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        values = np.fromiter((x for c in coded if c for x in c), np.int32, int(offsets[-1]))
        nulls = pa.array([c is None for c in coded], pa.bool_())
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=nulls)
        if not check:
            return [ids]
        return [ids, pa.array([None if c is None else codec.decode(c) == t for c, t in zip(coded, texts, strict=True)], pa.bool_())]

    return _map(df, load(model_path, scores), text_col, [(ids_col, "array<int>"), *([(check_col, "boolean")] if check else [])], work)


def decode(df: DataFrame, ids_col: str = "ids", text_col: str = "decoded", model_path: str = MODEL) -> DataFrame:
    """``df`` with the text of each list of ids."""
    def work(codec: Codec, lists: list[list[int] | None]) -> list[pa.Array]:
        return [pa.array([None if x is None else codec.decode(x) for x in lists], pa.string())]

    return _map(df, load(model_path), ids_col, [(text_col, "string")], work)
