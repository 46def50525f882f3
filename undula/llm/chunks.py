"""Exact tokenizing through a cache of space-delimited chunks."""

from __future__ import annotations

import os
from collections import Counter
from itertools import accumulate, chain, pairwise

import numpy as np

#: ASCII marks that always end a pre-token when a letter stands before them and nothing follows in the chunk.
CLOSING = ".,!?;:"
#: How byte-level vocabularies write a space, and the others the end of a word; chunks that the library gets as one text.
SPACE, END, JOINED = "Ġ", "</w>", 2000


class ChunkEncoder:
    """Token ids of whole texts, equal to the tokenizers library's own, as little-endian 32-bit bytes.

    A text is cut before its spaces. Where neither side of such a space is white space, no pre-token of the two supported
    tokenizers crosses the cut, so the chunks' ids joined are the text's ids, and each distinct chunk is encoded once per
    worker. A text with other cuts goes to the library whole. `space` tells whether a space belongs to the word after it
    (byte-level BPE) or is dropped (word-end BPE, for which every cut at a space is exact).
    The cache holds at most `limit` chunks; further ones are encoded again when they come.
    """

    def __init__(self, path: str, space: bool, limit: int = 500_000):
        # Each task has a core; threads of the library's own would only hold memory of their own.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.space, self.limit = space, limit
        self.ids: dict[str, bytes | None] = {}
        self.edge = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in self.library.get_vocab().items():
            self.edge[i] = token.startswith(SPACE) if space else token.endswith(END)

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of safe chunks. Many go to the library as one text: each with its space begins where an id that opens with
        a space stands, or, where spaces are dropped, a word of letters alone ends with an id that closes a word."""
        if self.space:
            return self._encode_joined([" " + c for c in chunks])
        found = dict(zip(words := [c for c in chunks if c.isalpha()], self._encode_joined([" " + c for c in words]), strict=True))
        found.update(zip(rest := [c for c in chunks if c not in found], self._encode(rest), strict=True))
        return [found[c] for c in chunks]

    def _encode_joined(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for a in range(0, len(chunks), JOINED):
            own = chunks[a : a + JOINED]
            ids = np.array(self.library.encode_batch_fast(["".join(own)], add_special_tokens=False)[0].ids, "<u4")
            edges = np.flatnonzero(self.edge[ids])
            if len(edges) != len(own):
                out += self._encode(own)
                continue
            cuts = [*edges.tolist(), len(ids)] if self.space else [0, *(edges + 1).tolist()]
            raw = ids.tobytes()
            out += [raw[4 * i : 4 * j] for i, j in pairwise(cuts)]
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        ends = [0, *accumulate(map(len, ids))]
        joined = np.fromiter(chain.from_iterable(ids), dtype="<u4", count=ends[-1]).tobytes()
        return [joined[4 * a : 4 * b] for a, b in pairwise(ends)]

    def _unsafe(self, chunk: str) -> bool:
        return self.space and (not chunk or chunk.strip() != chunk)

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [t.split(" ") for t in texts]
        ids = self.ids
        new = {c for c in set(chain.from_iterable(c[1:] for c in cut)) if c not in ids}
        # A letter and a closing mark are apart in both tokenizers: encode the word once, whatever mark follows it. Some letters
        # become others in lower case: what stands before the mark then has to be a letter, too.
        ends = {c for c in new if len(c) > 1 and c[-1] in CLOSING and c[-2] < "ɐ" and c[-2].isalpha() and c[-2].lower().isalpha()}
        plain = new - ends
        plain.update(w for c in ends if (w := c[:-1]) not in ids)
        marks = dict(zip(CLOSING, self._encode(list(CLOSING)), strict=True))
        found: dict[str, bytes | None] = {c: None for c in plain if self._unsafe(c)}
        safe = [c for c in plain if c not in found]
        found.update(zip(safe, self._encode_chunks(safe), strict=True))
        for c in ends:
            word = found[c[:-1]] if c[:-1] in found else ids[c[:-1]]
            found[c] = None if word is None else word + marks[c[-1]]
        room = self.limit - len(ids)
        if room >= len(found):
            ids.update(found)
            found = {}
        elif room > 0:  # the last to be kept are those used most often here, whole words being used with their marks, too
            uses = Counter(chain.from_iterable(c[1:] for c in cut))
            ids.update((c, found[c]) for c in sorted(found, key=uses.__getitem__, reverse=True)[:room])
        first = self._encode([c[0] for c in cut])
        out: list[bytes] = []
        for text, chunks, head in zip(texts, cut, first, strict=True):
            try:
                if found:
                    body = b"".join([found[c] if c in found else ids[c] for c in chunks[1:]])
                else:
                    body = b"".join(map(ids.__getitem__, chunks[1:]))
                if self._unsafe(chunks[0]) and len(chunks) > 1:
                    raise TypeError
                out.append(head + body)
            except TypeError:  # an unsafe chunk
                out.append(self._encode([text])[0])
        return out


_encoders: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, space: bool, limit: int = 500_000) -> ChunkEncoder:
    """This Python worker's encoder, kept from task to task."""
    if (path, space) not in _encoders:
        _encoders[path, space] = ChunkEncoder(path, space, limit)
    return _encoders[path, space]


def forget_encoders() -> None:
    _encoders.clear()


def in_blocks(texts: list[str], chars: int = 2_000_000):
    """Slices of `texts` of about so many characters each, so that memory follows neither the batch nor its longest text."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
