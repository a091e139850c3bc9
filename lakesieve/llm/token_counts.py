"""Token counts that follow edits without counting a document again.

A document's pre-tokens are the leaves of a tree of at most FAN children a node; every node knows how many pre-tokens,
characters and tokens stand below it. An edit finds its place from these sums, re-cuts text from the pre-token before the
last that ends ahead of it (and white space before that) until a new pre-token begins where an old one did behind the
edit (from there all are as before, since a cut depends on the text behind it only), encodes those anew and replaces the
nodes on the way to them; all other nodes stay as they are. So an edit costs what it touches and the tree's height, not
the document's length.

Null and empty texts have no tokens; each row is counted by itself, repeated rows alike; a text of any length is one tree;
a name that the kept columns have already gets a leading underscore; an empty table gives no rows. The merge ranks are
read once by the driver, from the path given, and sent to the tasks.
"""

from __future__ import annotations

import base64
import re

import numpy as np
from pyspark.sql import DataFrame

from lakesieve.llm._bytes import Texts
from lakesieve.llm._rows import with_measures
from lakesieve.llm._spark import free_name

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Children of a node, at most twice as many after edits; distinct pre-tokens that a worker remembers; text that an edit cuts at first.
FAN, REMEMBERED, AHEAD = 32, 500_000, 64
EDITS = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\b\d{1,3}(?:\.\d{1,3}){3}\b")
REPLACEMENT = "[REDACTED]"

_made: dict[int, tuple] = {}


class Coder:
    """Cuts texts into pre-tokens and counts the tokens of each."""

    def __init__(self, ranks: bytes):
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines())}
        self.cutter = regex.compile(PATTERN)
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})._core_bpe.encode_single_piece
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.known[piece] = len(self.encode(piece.encode()))
        return n


def ranks_of(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def coder(ranks: bytes) -> Coder:
    """The coder of a broadcast's value, made once in a worker."""
    if id(ranks) not in _made:
        _made.clear()
        _made[id(ranks)] = Coder(ranks), ranks
    return _made[id(ranks)][0]


class Node:
    """Pre-tokens with their token counts, or nodes; and the sums over them."""

    __slots__ = ("chars", "counts", "kids", "n", "tokens")

    def __init__(self, kids: list, counts: list[int] | None):
        self.kids, self.counts = kids, counts
        if counts is None:
            self.n, self.chars, self.tokens = sum(k.n for k in kids), sum(k.chars for k in kids), sum(k.tokens for k in kids)
        else:
            self.n, self.chars, self.tokens = len(kids), sum(map(len, kids)), sum(counts)


def grouped(kids: list, counts: list[int] | None) -> list[Node]:
    """`kids` under as few nodes as hold them; up to twice FAN stay together."""
    if len(kids) <= 2 * FAN:
        return [Node(kids, counts)] if kids else []
    return [Node(kids[i : i + FAN], None if counts is None else counts[i : i + FAN]) for i in range(0, len(kids), FAN)]


def replaced(node: Node, lo: int, hi: int, pieces: list[str], counts: list[int]) -> list[Node]:
    """What stands for `node` when `pieces` take the place of its pre-tokens lo to hi."""
    if node.counts is not None:
        return grouped(node.kids[:lo] + pieces + node.kids[hi:], node.counts[:lo] + counts + node.counts[hi:])
    out, at, put = [], 0, False
    for kid in node.kids:
        a, b = max(lo - at, 0), min(hi - at, kid.n)
        if not put and lo <= at + kid.n:  # the first that reaches the place takes what is new
            out += replaced(kid, a, max(b, a), pieces, counts)
            put = True
        elif a < b:
            out += replaced(kid, a, b, [], []) if (a, b) != (0, kid.n) else []
        else:
            out.append(kid)
        at += kid.n
    return grouped(out, None)


class Counted:
    """A text as a tree of pre-tokens."""

    def __init__(self, text: str, by: Coder):
        self.by, self.recounted = by, 0
        pieces = by.cutter.findall(text)
        self._stand(grouped(pieces, [by.count(p) for p in pieces]))

    def _stand(self, nodes: list[Node]) -> None:
        while len(nodes) > 1:
            nodes = grouped(nodes, None)
        self.root = nodes[0] if nodes else Node([], [])
        while self.root.counts is None and len(self.root.kids) == 1:
            self.root = self.root.kids[0]

    @property
    def total(self) -> int:
        return self.root.tokens

    def pieces(self, lo: int = 0, node: Node | None = None):
        """The pre-tokens from number lo on."""
        node = node or self.root
        for kid in node.kids[lo:] if node.counts is not None else node.kids:
            if node.counts is not None:
                yield kid
            else:
                if lo < kid.n:
                    yield from self.pieces(max(lo, 0), kid)
                lo -= kid.n

    @property
    def text(self) -> str:
        return "".join(self.pieces())

    def place(self, char: int) -> tuple[int, int]:
        """(number, start) of the first pre-token that ends at `char` or later; those of the end beyond the last."""
        node, number, start = self.root, 0, 0
        while True:
            for kid in node.kids:
                chars, n = (len(kid), 1) if node.counts is not None else (kid.chars, kid.n)
                if start + chars >= char:
                    break
                number, start = number + n, start + chars
            else:
                return number, start
            if node.counts is not None:
                return number, start
            node = kid

    def piece(self, number: int) -> str:
        return next(self.pieces(number))

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters from start to end."""
        first, begin = self.place(start)
        back = 1  # a contraction looks two characters ahead
        while first and (back or self.piece(first - 1).isspace()):  # white space looks to its run's end
            back = max(back - 1, 0)
            first -= 1
            begin -= len(self.piece(first))
        old, ends, at, width = [], {}, begin, (end - begin) + AHEAD
        rest = self.pieces(first)
        while True:
            for p in rest:
                if at >= end:
                    ends[at] = first + len(old)  # where an old pre-token begins behind the edit
                old.append(p)
                at += len(p)
                if at - begin >= width:
                    break
            whole = at == self.root.chars
            held = "".join(old)
            text = held[: start - begin] + new + held[end - begin :]
            shift, fresh, last = len(new) - (end - start), [], None
            for m in self.by.cutter.finditer(text):
                if m.start() >= start - begin + len(new) and (whole or m.start() < len(text) - 2) and (last := ends.get(begin + m.start() - shift)) is not None:
                    break
                fresh.append(m[0])
            if last is not None or whole:
                break
            width *= 2  # the cut has not met an old one yet
        last = first + len(old) if last is None else last
        counts = [self.by.count(p) for p in fresh]
        self.recounted += len(fresh)
        self._stand(replaced(self.root, first, last, fresh, counts))


def count_edited(df: DataFrame, text: str = "text", keep: list[str] | None = None, ranks: str = RANKS, pattern=EDITS, replacement: str = REPLACEMENT) -> DataFrame:
    """The columns `keep` (default: all but the text) with n_tokens, n_edits, n_recounted (pre-tokens encoded again) and n_tokens_after."""
    keep = [c for c in df.columns if c != text] if keep is None else keep
    names = [free_name(keep, n) for n in ("n_tokens", "n_edits", "n_recounted", "n_tokens_after")]
    sent = df.sparkSession.sparkContext.broadcast(ranks_of(ranks))  # a tokenizer's vocabulary: its size doesn't follow the data

    def measure(texts: Texts):
        by = coder(sent.value)
        raw, offs, rows = texts.data.tobytes(), texts.offs.tolist(), []
        for a, b in zip(offs[:-1], offs[1:], strict=True):
            body = raw[a:b].decode("utf-8", "replace")
            held = Counted(body, by)
            before, spans = held.total, [m.span() for m in pattern.finditer(body)]
            for s, e in reversed(spans):
                held.edit(s, e, replacement)
            rows.append((before, len(spans), held.recounted, held.total))
        return dict(zip(names, np.array(rows, np.int64).reshape(-1, 4).T, strict=True))

    return with_measures(df, text, dict.fromkeys(names, "bigint"), measure, keep)
