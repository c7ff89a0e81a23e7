"""Byte-level BPE ids of whole texts, as the tokenizers library gives them.

The vocabulary's pattern never lets a piece reach across a step from a
non-space to a space character, or from a letter to an ASCII mark, so a text
can be cut there and the cuts encoded one by one. Cuts repeat, so each is
encoded once and kept in a bounded memo; a text's ids are the joined ids of
its cuts. The memo stands in for the library's own cache, which is off. A cut
of letters is one piece, so the library encodes many of them at once without
its pattern: they stand between line breaks, which no id has in common with
them. Texts with runs of spaces, or with a space character other than the
ASCII ones before a cut, are encoded whole: there what follows matters. So are
texts that hold a special token of the vocabulary, which is one id as in the
library's plain call.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cuts, and their characters, kept by a worker; beyond this the memo starts anew, which only costs time.
MEMO, MEMO_CHARS = 900_000, 16 << 20
#: Cuts encoded at once; texts cut at once, and their characters.
TOGETHER, TEXTS, TEXT_CHARS = 256, 1024, 4 << 20
NEWLINE = "\n"
#: What the memo holds for a cut whose text must be encoded whole; every other has ids.
WHOLE = b""
MARKS = frozenset("!\"#$%&()*+,-./:;<=>?@[]^_`{|}~\\")
#: Letters in any version of Unicode, and the places (U+0100 on up) that their first bytes and a space have in ids.
LETTERS = re.compile("\n?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481]+").fullmatch
JOINED = re.compile("[^\u010a]\u010a|\u010a[\u0120A-Za-z\u00c3-\u00d2]").search


class Encoder:
    """ids(texts): for each text its ids as unsigned little-endian 32-bit bytes."""

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # Both share the model in memory.
        self.speller = Tokenizer(self.tokenizer.model)
        self.speller.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        for t in (self.tokenizer, self.speller):
            t.model._resize_cache(0)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = memo
        #: Ids of a space and the cut, or of a line break and the cut that begins a
        #: line (its key begins so too); nothing where the text must be encoded whole.
        self.memo: dict[str, bytes] = {}
        self.chars = 0
        self.line = self.whole([NEWLINE])[0]
        self.break_id = int(np.frombuffer(self.line, "<u4")[0]) if len(self.line) == 4 else None
        #: Whether line breaks keep letters apart without the pattern.
        self.apart = self.break_id is not None and not any(map(JOINED, self.tokenizer.get_vocab()))

    def whole(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in got]

    def _together(self, tokenizer, cuts: list[str], before: str) -> list[bytes]:
        """Ids of cuts, each behind the same, many in one text: a line break
        between them is a piece of its own."""
        out: list[bytes] = []
        for at in range(0, len(cuts), TOGETHER):
            part = cuts[at : at + TOGETHER]
            text = before + (NEWLINE + before).join(part)
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.break_id)
            if len(ends) != len(part) - 1:
                out += self.whole([before + c for c in part])
                continue
            raw, ends = ids.tobytes(), (4 * ends).tolist()
            out += [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(raw)])]
        return out

    def _learn(self, cuts: list[str]) -> None:
        """Encode cuts that the memo doesn't know yet."""
        memo, line = self.memo, self.line
        letters: set[str] = set()
        tails, others = [], []
        for c in cuts:
            self.chars += len(c)
            stem = c[:-1] if c[-1] in MARKS else c
            if not (self.apart and LETTERS(stem)):
                others.append(c)
                continue
            if stem is not c:
                tails.append(c)
                if stem in memo:
                    continue
            letters.add(stem)
        words = [c for c in letters if c[0] != NEWLINE]
        memo.update(zip(words, self._together(self.speller, words, " ")))
        heads = [c for c in letters if c[0] == NEWLINE]
        for c, ids in zip(heads, self._together(self.speller, [c[1:] for c in heads], "")):
            memo[c] = line + ids
        mark = {m: self.whole([m])[0] for m in {c[-1] for c in tails}}
        for c in tails:
            memo[c] = memo[c[:-1]] + mark[c[-1]]
        plain = [c for c in others if c.split() == [c]] if self.break_id is not None else []
        memo.update(zip(plain, self._together(self.tokenizer, plain, " ")))
        for c in set(others).difference(plain):
            if c[0] == NEWLINE:
                memo[c] = WHOLE if c[1].isspace() or c[-1].isspace() else line + self.whole([c[1:]])[0]
            else:
                memo[c] = WHOLE if c[-1].isspace() else self.whole([" " + c])[0]

    def ids(self, texts: list[str]) -> list[bytes]:
        # Nothing here makes cycles, and looking for them among so many lists costs a tenth of the time.
        looks = gc.isenabled()
        gc.disable()
        try:
            return self._ids(texts)
        finally:
            if looks:
                gc.enable()

    def _lined(self, text: str) -> str | None:
        """Cuts with spaces between them, those that begin a line behind its
        break; None where the text must be encoded whole."""
        if not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ("  ", "\n\n", " \n", "\n ", *self.special)):
            return None
        return NEWLINE + text.replace(NEWLINE, " \n")

    def _ids(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > self.most or self.chars > MEMO_CHARS:
            self.memo, self.chars = {}, 0
        # Null where a text is encoded whole. Only distinct cuts become Python objects.
        cuts = pc.split_pattern(pa.array(map(self._lined, texts), pa.large_string()), " ")
        flat = cuts.flatten().dictionary_encode()
        distinct = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        # Each is looked up once; those not there yet are learnt together and filled in.
        got = list(map(self.memo.get, distinct))
        holes = [i for i, ids in enumerate(got) if ids is None]
        self._learn([distinct[i] for i in holes])
        for i in holes:
            got[i] = self.memo[distinct[i]]
        found = pa.array(got, pa.large_binary()).take(flat.indices)
        ends = np.frombuffer(found.buffers()[1], "<i8", len(found) + 1, 8 * found.offset)
        edges = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(cuts), 0).to_numpy()))
        whole = np.diff(np.append(0, np.cumsum(ends[1:] == ends[:-1]))[edges]) > 0
        raw, out = memoryview(found.buffers()[2] or b""), []
        for t, c, a, b, w in zip(texts, cuts.is_valid().to_pylist(), ends[edges[:-1]].tolist(), ends[edges[1:]].tolist(), whole.tolist()):
            # The first line's break isn't the text's.
            out.append(bytes(raw[a + len(self.line) : b]) if c and not w else self.whole([t])[0])
        return out


def together(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows of id and text, as many as are worth encoding at once."""
    held, chars = [], 0
    for r in rows:
        held.append(r)
        chars += len(r[1])
        if chars >= TEXT_CHARS or len(held) >= TEXTS:
            yield held
            held, chars = [], 0
    if held:
        yield held


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
