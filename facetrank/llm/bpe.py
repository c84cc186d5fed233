"""Encoding of texts by a public byte-level BPE vocabulary, as a bounded-lookahead streaming transducer, and back.

Every text is read in segments of SEGMENT characters, and the tokens of a segment are emitted once nothing that follows
can change them:

* Between characters of different classes the splitting pattern always ends a piece, but for a blank before a word and
  an apostrophe before letters. One character of lookahead decides. Nearly every segment is emitted up to such a place
  near its end; what is behind it begins the next one.
* A run of one class that is longer than a segment is one piece, in which merges may reach far. There the segment is
  encoded, and its tokens are emitted up to the sufficient lookahead of the merge list before its end. The next segment
  starts after the last token emitted; the seam is checked by merging the tokens there together, and moved back if
  they change. (Tokens are the encoding of their bytes exactly if each two neighbours are that of theirs.)

So the working memory beside the text and its ids is a segment, however long the text or the piece. The merges inside a
segment are those of an installed library; classes of characters are asked of the same library's patterns.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetrank.functions.runtime import ship, spread

#: Characters of a segment.
SEGMENT = 256
#: Characters of a segment inside a piece that is longer than that.
INNER = 1 << 12
#: Fixed value: the pattern by which byte_bpe_50k splits texts before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The pieces of that pattern that end inside a run of letters.
CONTRACTION = re.compile(r"'(?:s|t|re|ve|m|ll|d)")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Tokens and ids of a rank file: a line of base64 and number for each."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def sufficient_lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes after a token boundary that can decide about it.

    What follows a token t changes it only if t's last part merges to the right before it merges to the left: by a
    merge of lower rank that takes that part as its left side. That merge itself can be prevented from its right in the
    same way, by one of lower rank still. The longest such chain, in bytes of left sides, and one longest token bound
    the reach. Found in one pass over the merges by rising rank.
    """
    reach: dict[bytes, int] = {}
    longest = max(map(len, ranks), default=1)
    best = 0
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        # The last merge of a token is its split into two tokens whose greater rank is least.
        split = min(
            (max(ranks[token[:i]], ranks[token[i:]]), i) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks
        )[1] if len(token) > 1 and any(token[:i] in ranks and token[i:] in ranks for i in range(1, len(token))) else 0
        if split:
            left, right = token[:split], token[split:]
            chain = len(left) + reach.get(right, len(right))
            reach[left] = max(reach.get(left, 0), chain)
            best = max(best, chain)
    return best + longest


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of a few bytes: the pair of least rank is merged, the first of equal ones, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], len(ranks) + 256), i) for i in range(len(parts) - 1))
        if parts[at] + parts[at + 1] not in ranks:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Classes(dict):
    """Class of a character in the splitting pattern: s for a blank, L for a letter, N for a number, o for others."""

    def __init__(self) -> None:
        import tiktoken

        # What a pattern doesn't match gives no tokens.
        single = {bytes([i]): i for i in range(256)}
        kinds = (("s", r"\s"), ("L", r"\p{L}"), ("N", r"\p{N}"))
        self.coders = [(k, tiktoken.Encoding(k, pat_str=p, mergeable_ranks=single, special_tokens={})) for k, p in kinds]

    def __missing__(self, c: str) -> str:
        self[c] = next((k for k, coder in self.coders if coder.encode_ordinary(c)), "o")
        return self[c]


class Transducer:
    def __init__(self, ranks: dict[bytes, int], segment: int = SEGMENT, inner: int = INNER) -> None:
        import tiktoken

        self.coder = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.within = tiktoken.Encoding("within", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.classes = Classes()
        self.lookahead = sufficient_lookahead(ranks)
        self.segment, self.inner = segment, max(inner, 2 * self.lookahead)
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; a null or empty text has none."""
        out: list[int] = []
        for part in self.stream(text or ""):
            out += part
        return out

    def stream(self, text: str) -> Iterator[list[int]]:
        """The ids, segment by segment."""
        at, size = 0, len(text)
        while at < size:
            end = self.boundary(text, at, min(at + self.segment, size))
            if end > at:
                yield self.coder.encode_ordinary(text[at:end])
                at = end
            else:
                end = self.piece_end(text, at)
                yield from self.long_piece(text, at, end)
                at = end

    def boundary(self, text: str, first: int, last: int) -> int:
        """The last place in (first, last] where a piece is certain to end, else `first`."""
        if last == len(text):
            return last
        kind = self.classes
        b = kind[text[last]]
        for at in range(last, first, -1):
            a = kind[text[at - 1]]
            if a != b and a != "s" and not (b == "L" and text[at - 1] == "'"):
                return at
            b = a
        return first

    def piece_end(self, text: str, at: int) -> int:
        """Where the piece that starts at `at` ends."""
        contraction = CONTRACTION.match(text, at)
        if contraction:
            return contraction.end()
        classes, end = self.classes, at + 1
        kind = classes[text[at]]
        if text[at] == " " and end < len(text):
            kind = classes[text[end]]
        while end < len(text) and classes[text[end]] == kind:
            end += 1
        # Of a run of blanks before other characters, the last blank belongs to what follows.
        return end - 1 if kind == "s" and end < len(text) and end - at > 1 else end

    def long_piece(self, text: str, start: int, end: int) -> Iterator[list[int]]:
        """The ids of one piece, segment by segment."""
        kept = ""
        held: list[int] = []
        for a in range(start, end, self.inner):
            kept += text[a : min(a + self.inner, end)]
            ids = self.within.encode_ordinary(kept)
            # The seam: the tokens on both sides must stay apart when merged together.
            if held and not self.apart(held[-1], ids[0]):
                kept, held = self.bytes_of(held).decode() + kept, []
                ids = self.within.encode_ordinary(kept)
            if a + self.inner >= end:
                yield held + ids
                return
            # Places after whole characters, before the stretch that may still change: the last, and one before it.
            places = self.places(ids)
            if len(places) < 2:
                continue
            yield held + ids[: places[-2]]
            held = ids[places[-2] : places[-1]]
            kept = self.bytes_of(ids[places[-1] :]).decode()

    def places(self, ids: list[int]) -> list[int]:
        """Numbers of first tokens, rising, that end with a whole character at least the lookahead before the end."""
        out: list[int] = []
        left = 0
        for n in range(len(ids) - 1, 0, -1):
            token = self.tokens[ids[n]]
            left += len(token)
            # A byte that continues a character has the bits 10 in front.
            if left >= self.lookahead and token[0] >> 6 != 0b10:
                out.append(n)
                if len(out) == 2:
                    break
        return out[::-1]

    def apart(self, left: int, right: int) -> bool:
        a, b = self.tokens[left], self.tokens[right]
        return merged(a + b, self.ranks) == [a, b]

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(self.tokens[i] for i in ids)


class Utf8Machine:
    """Text of bytes that come in parts: what may still become a character waits for the next part."""

    def __init__(self) -> None:
        self.waiting = b""

    def feed(self, data: bytes, final: bool = False) -> str:
        data = self.waiting + data
        cut = len(data)
        if not final:
            for back in range(1, min(3, len(data)) + 1):
                byte = data[-back]
                if byte & 0xC0 == 0x80:
                    continue
                need = 2 if byte >> 5 == 0b110 else 3 if byte >> 4 == 0b1110 else 4 if byte >> 3 == 0b11110 else 1
                cut = len(data) - back if need > back else len(data)
                break
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")


def decode(ids: list[int], tokens: dict[int, bytes], part: int = 4096) -> str:
    machine = Utf8Machine()
    out = [machine.feed(b"".join(tokens[i] for i in ids[a : a + part])) for a in range(0, len(ids), part)]
    return "".join([*out, machine.feed(b"", final=True)])


_made: dict[bytes, Transducer] = {}


def _transducer(data: bytes) -> Transducer:
    """One a Python worker and vocabulary."""
    key = hashlib.sha256(data).digest()
    if key not in _made:
        _made[key] = Transducer(load_ranks(data))
    return _made[key]


def _texts(column: pa.Array) -> Iterator[str | None]:
    """Texts one by one, so that a batch of very long ones isn't copied as a whole."""
    for value in column:
        yield value.as_py()


def encode_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, count_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, ids ARRAY<INT>), or (key, `keep` columns, n_tokens) with `count_only`: one row a row of `documents`.

    Null and empty texts give an empty list. Null or repeated keys are kept as they are; other columns are ignored;
    an empty table gives no rows. vocabulary: path of a rank file, read once on the driver and sent along.
    """
    with open(vocabulary or default_vocabulary(), "rb") as f:
        data = documents.sparkSession.sparkContext.broadcast(f.read())
    names = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or _transducer(data.value)
            sizes = np.zeros(batch.num_rows + 1, dtype=np.int64)
            parts: list[np.ndarray] = []
            start, total = 0, 0
            columns = [batch.column(i) for i in range(len(names))]
            for i, value in enumerate(_texts(batch.column(len(names)))):
                ids = coder.encode(value)
                sizes[i + 1] = len(ids)
                total += len(ids)
                if not count_only:
                    parts.append(np.array(ids, dtype=np.int32))
                    # Rows go on in blocks of bounded size.
                    if total > 4_000_000:
                        yield block(columns, parts, sizes, start, i + 1)
                        start, total, parts = i + 1, 0, []
            if count_only:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes[1:])], names=[*names, "n_tokens"])
            elif start < batch.num_rows:
                yield block(columns, parts, sizes, start, batch.num_rows)

    def block(columns, parts, sizes, a, b) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum(sizes[a + 1 : b + 1])]).astype(np.int32)
        flat = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
        return pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in columns), lists], names=[*names, "ids"])

    kinds = [f"`{n}` {documents.schema[n].dataType.simpleString()}" for n in names]
    out = ", ".join([*kinds, "n_tokens bigint" if count_only else "ids array<int>"])
    return spread(documents.select(*names, F.col(text).cast("string").alias("_text"))).mapInArrow(run, out)


def decode_ids(encoded: DataFrame, key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """(key, text): the texts of lists of ids; null lists give null, empty ones an empty text."""
    with open(vocabulary or default_vocabulary(), "rb") as f:
        data = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = None
        for batch in batches:
            tokens = tokens or {v: k for k, v in load_ranks(data.value).items()}
            texts = [None if ids is None else decode(ids, tokens) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text string")


ship(__name__)
