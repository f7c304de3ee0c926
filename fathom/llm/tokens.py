"""Token ids of whole texts, by the tokenizers library."""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterable, Iterator, Sequence

from .common import kept

_MARKS = b".,;:!?"
#: Letters of U+00C0 to U+027F and ASCII, after a blank or without: one pre-token.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc9][\x80-\xbf])+")
_ENCODERS: dict = kept()


def _alphabet() -> str:
    """The character that a byte-level BPE has for each byte: printable Latin-1 stands for itself, the others follow U+0100 in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256))
    return "".join(chr(b) if b in own else chr(256 + next(rest)) for b in range(256))


def _tables(np):
    """Per byte: may begin a character that is no white space (1), or that may be white space, by the byte after it (2)."""
    solid = np.zeros(256, np.uint8)
    solid[0x21:0x7F] = 1
    solid[0xC2:0xF5] = 1
    solid[[0xC2, 0xE1, 0xE2, 0xE3]] = 2
    word = np.zeros(256, bool)
    word[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
    mark = np.zeros(256, bool)
    mark[list(_MARKS)] = True
    space = np.zeros(256, bool)
    space[[9, 10, 13, 32]] = True
    return solid, word, mark, space


class IdEncoder:
    """Texts to unsigned 32-bit ids, many texts at a time.

    A byte-level BPE of the usual pattern starts a new pre-token, whatever stands around, at a blank that a non-blank
    follows; before and after a line end that a non-blank follows; and at a punctuation mark between an ASCII letter or digit
    and white space (or the end). The texts of a batch are cut at all these places at once, by comparing bytes; equal pieces are found by
    Arrow's dictionary encoding; only pieces that the worker hasn't kept go through the library. Each piece gives the same ids
    alone as in its text: what the pattern looks ahead to after a cut is white space, or the cut is at a single line end.
    Tokenizers of another kind (see _cuttable) encode whole texts in the library. At most `keep` pieces of at most `longest`
    bytes are kept; when they are full, those met in one batch only are dropped.
    """

    def __init__(self, path: str, end_id: int | None = 2, pieces: bool = True, keep: int = 600_000, longest: int = 48):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        self.np = np
        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True  # their strings in a text are ordinary text
        self.end_id, self.keep, self.longest = end_id, keep, longest
        self.pieces = pieces and self._cuttable()
        self.solid, self.word, self.mark, self.space = _tables(np)
        if self.pieces:
            vocab = self.lib.get_vocab()
            self.widths = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
            for token, i in vocab.items():
                self.widths[i] = len(token)  # the byte-level alphabet has a character for each byte
            self.alphabet = _alphabet()
            self.alphabet = self.alphabet[:10] + "\n" + self.alphabet[11:]
            self.words = Tokenizer.from_file(path)  # the same model over words that are told apart by line ends: no pattern to match
            self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
            if hasattr(self.words.model, "_resize_cache"):
                self.words.model._resize_cache(0)  # no word comes twice
            self._forget()

    def _cuttable(self) -> bool:
        from tokenizers import models, pre_tokenizers

        p = self.lib.pre_tokenizer
        return isinstance(p, pre_tokenizers.ByteLevel) and p.use_regex and not p.add_prefix_space and self.lib.normalizer is None and isinstance(self.lib.model, models.BPE) and len(self._library(["\n"])[0]) == 1

    def _forget(self) -> None:
        np = self.np
        self.known: dict[bytes, int] = {}
        self.ids, self.n_ids = np.empty(1 << 16, np.uint32), 0
        self.start, self.size, self.hits = np.empty(1 << 15, np.int64), np.empty(1 << 15, np.int64), np.zeros(1 << 15, np.uint8)

    def _library(self, texts: list[str]) -> list:
        return [self.np.array(e.ids, dtype=self.np.uint32) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _strung(self, pieces: list[bytes], lead: bytes, at_once: int = 1 << 16) -> tuple:
        """(ids, sizes) of pieces that each begin a pre-token after `lead`: strung together as texts of their own, and told apart by
        the bytes that each id stands for. The id of lead, if any, is dropped."""
        np = self.np
        out, sizes, begin, total = [], [], 0, 0
        for k, x in enumerate(pieces, 1):
            total += len(x)
            if total >= at_once or k == len(pieces):
                part = pieces[begin:k]
                ids = self._library([(lead + lead.join(part)).decode()])[0]
                ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + len(lead))
                cuts = np.searchsorted(np.cumsum(self.widths[ids]), ends, side="left") + 1
                if lead:
                    ids = np.delete(ids, np.concatenate([[0], cuts[:-1]]))
                    cuts = cuts - np.arange(1, len(cuts) + 1)
                out.append(ids)
                sizes.append(np.diff(cuts, prepend=0))
                begin, total = k, 0
        return out, sizes

    def _words(self, pieces: list[bytes], at_once: int = 8192) -> tuple:
        """(ids, sizes) of pieces that are one pre-token each."""
        np = self.np
        out, sizes = [], []
        for begin in range(0, len(pieces), at_once):
            part = pieces[begin : begin + at_once]
            text = b"\n".join(part).decode("latin-1").translate(self.alphabet)
            ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))
            out.append(ids)
            sizes.append(np.diff(np.searchsorted(np.cumsum(self.widths[ids]), ends, side="left") + 1, prepend=0))
        return out, sizes

    def _begins(self, data: bytes) -> int:
        """3 if it is one word, 1 if a non-blank begins it, 2 if a blank and then a non-blank, else 0."""
        if _WORD.fullmatch(data):
            return 3
        at = data[:1] == b" "
        if len(data) <= at:
            return 0
        kind = self.solid[data[at]]
        if kind == 2:
            after = data[at + 1] if len(data) > at + 1 else 0
            kind = 0 if after in (0x80, 0x81, 0x85, 0x9A, 0xA0) else 1
        return (1 + at) if kind else 0

    def _learn(self, new: list[bytes]) -> None:
        """Ids of pieces into the kept tables, in the given order."""
        np = self.np
        kinds = [self._begins(x) for x in new]
        ids, sizes = [], np.empty(len(new), np.int64)
        order = []
        for kind, lead in ((3, None), (2, b""), (1, b"\n")):
            at = [i for i, k in enumerate(kinds) if k == kind]
            if at:
                got, n = self._words([new[i] for i in at]) if kind == 3 else self._strung([new[i] for i in at], lead)
                ids += got
                sizes[at] = np.concatenate(n)
                order += at
        if at := [i for i, k in enumerate(kinds) if not k]:
            got = self._library([new[i].decode() for i in at])
            ids += got
            sizes[at] = [len(x) for x in got]
            order += at
        flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        first, n = len(self.known), len(new)
        while first + n > len(self.start):
            self.start, self.size, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.hits))
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        ends = np.cumsum(sizes[order])
        self.start[first + np.array(order, np.int64)] = self.n_ids + ends - sizes[order]
        self.size[first : first + n] = sizes
        self.hits[first : first + n] = 0
        self.n_ids += len(flat)
        self.known.update(zip(new, range(first, first + n), strict=True))

    def _thin(self) -> None:
        """Keeps the pieces met in more than one batch since the last time, of bounded length; none if that still leaves too many."""
        np = self.np
        names = [x for x, i in self.known.items() if self.hits[i] > 1 and len(x) <= self.longest]
        if len(names) > self.keep // 2:
            names = []
        at = np.fromiter((self.known[x] for x in names), np.int64, len(names))
        ids, start, size = self.ids, self.start, self.size
        sizes = size[at]
        ends = np.cumsum(sizes)
        flat = ids[np.repeat(start[at] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self._forget()
        n = len(names)
        while n > len(self.start):
            self.start, self.size, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.hits))
        self.ids = np.concatenate([flat, np.empty(1 << 16, np.uint32)])
        self.n_ids = len(flat)
        self.start[:n], self.size[:n] = ends - sizes, sizes
        self.known = dict(zip(names, range(n), strict=True))

    def _cuts(self, data, texts):
        """Where pieces begin, in ascending order, with the end of the data; texts: offsets of the texts."""
        np = self.np
        n = len(data)
        if not n:
            return np.zeros(1, np.int64)
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        last = np.zeros(n + 1, bool)
        last[texts[1:]] = True  # a text ends before here

        def solid_after(p):
            """Whether the character after byte p is in p's text and no white space."""
            kind = self.solid[padded[p + 1]]
            ok = kind == 1
            doubt = np.flatnonzero(kind == 2)
            if len(doubt):
                after = padded[p[doubt] + 2]
                ok[doubt] = ~np.isin(after, (0x80, 0x81, 0x85, 0x9A, 0xA0))
            return ok & ~last[p + 1]

        begins = np.zeros(n + 2, bool)
        begins[texts] = True
        blank = np.flatnonzero(data == 32)
        begins[blank[solid_after(blank)]] = True
        line = np.flatnonzero(data == 10)
        line = line[solid_after(line)]
        begins[line] = True
        begins[line + 1] = True
        mark = np.flatnonzero(self.mark[data])
        mark = mark[mark > 0]
        mark = mark[self.word[data[mark - 1]] & ~last[mark] & (self.space[padded[mark + 1]] | last[mark + 1])]
        begins[mark] = True
        begins[n] = True
        return np.flatnonzero(begins[: n + 1])

    def encode_batch(self, texts: Sequence[str | None]) -> tuple:
        """(ids, ends) of a batch of texts, an Arrow array or a sequence of str: all ids, end ids included, and for each text where its ids
        end. None counts as empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        np = self.np
        col = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if col.null_count:
            col = pc.fill_null(col, "")
        col = col.cast(pa.large_binary())
        n = len(col)
        if not n:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
        data = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if col.buffers()[2] is not None else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        if not self.pieces:
            got = self._library([bytes(data[a:b]).decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            return self._with_ends(np.concatenate(got), np.cumsum([len(x) for x in got]))
        gc.disable()  # nothing here is cyclic, and collections would walk the kept pieces again and again
        cuts = self._cuts(data, offsets)
        kind, width = (pa.binary(), np.int32) if len(data) < 1 << 31 else (pa.large_binary(), np.int64)
        found = pa.Array.from_buffers(kind, len(cuts) - 1, [None, pa.py_buffer(cuts.astype(width)), pa.py_buffer(data)]).dictionary_encode()
        names = found.dictionary.to_pylist()
        known = self.known
        at = np.fromiter((known.get(x, -1) for x in names), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        if len(new):
            first = len(known)
            self._learn([names[i] for i in new])
            at[new] = np.arange(first, first + len(new))
        self.hits[at] = np.minimum(self.hits[at], 200) + 1
        at = at[found.indices.to_numpy()]
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.start[at] - ends + size, size) + np.arange(total)]
        upto = np.concatenate([[0], ends])[np.searchsorted(cuts, offsets[1:])]
        if len(known) > self.keep:
            self._thin()
        return self._with_ends(ids, upto)

    def _with_ends(self, ids, upto) -> tuple:
        np = self.np
        if self.end_id is None:
            return ids, upto
        ends = upto + np.arange(1, len(upto) + 1)
        out = np.empty(len(ids) + len(upto), np.uint32)
        own = np.ones(len(out), bool)
        own[ends - 1] = False
        out[ends - 1] = self.end_id
        out[own] = ids
        return out, ends

    def encode_many(self, texts: Iterable[str | None], at_once: int = 1 << 22) -> Iterator[bytes]:
        """Little-endian ids of each text, in order; about at_once characters are worked on together."""
        group, size = [], 0
        for x in texts:
            group.append(x or "")
            size += len(group[-1])
            if size >= at_once:
                yield from self._parts(group)
                group, size = [], 0
        yield from self._parts(group)

    def _parts(self, texts: list[str]) -> Iterator[bytes]:
        ids, ends = self.encode_batch(texts)
        data, begin = ids.astype("<u4").tobytes(), 0
        for end in (4 * ends).tolist():
            yield data[begin:end]
            begin = end

    def encode(self, text: str | None) -> bytes:
        """Ids of one whole text, with the end id; None counts as empty."""
        return next(self.encode_many([text]))


def encoder(path: str, end_id: int | None) -> IdEncoder:
    """One per Python worker, until make_room()."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = IdEncoder(path, end_id)
    return _ENCODERS[path, end_id]


def slices(column, most_bytes: int = 4 << 20):
    """(begin, column slice) of an Arrow text column, each of about most_bytes; a longer text is alone."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(column):
        done = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, done + most_bytes, side="right")))
        yield begin, column.slice(begin, end - begin)
        begin = end
