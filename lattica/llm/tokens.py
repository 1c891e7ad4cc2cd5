"""Encoding with public tokenizer files, whole texts at a time, for use inside tasks.

A text is first cut where no token of it can cross, at white space; the tokenizer then encodes each distinct piece once and the ids of
a text are those of its pieces in order. The pieces' ids are held in arrays of bounded size. Many texts at once are cut by Arrow, which
also finds the distinct pieces; only those are looked up. A text that may hold the string of an added token, such as <|endoftext|>, is
encoded as a whole, as the plain library call does it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

#: Unicode's White_Space, as the tokenizers' patterns read \s.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters and, after them, marks between which every pattern cuts (no apostrophe: it may belong to a contraction).
LETTERS, MARKS = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff", "!-&(-/:-@\\[-`{-~"
CUTS = {
    # byte-level BPE: a space goes with the word after it; white space before " word" stands alone; other white space is left with its word
    "byte": re.compile(f" ?[{LETTERS}]+(?=[{MARKS}{SPACE}])| ?[^{SPACE}]+|[{SPACE}]+(?= [^{SPACE}])|\\n(?=[^{SPACE}])|[{SPACE}]+[^{SPACE}]+|[{SPACE}]+"),
    # BPE with word ends, which drops white space
    "word": re.compile(f"[{LETTERS}]+(?=[{MARKS}{SPACE}])|[^{SPACE}]+"),
}
#: The same cuts where Arrow makes them, as RE2 reads them: a letter before a mark, and a line feed between other characters.
WHITE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
EDGE, FEED = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}])([!-&(-/:-@\[-`{-~])", rf"([^{WHITE}])\n([^{WHITE}])"
#: Texts with a space after other white space, where a byte-level pattern needn't cut, or with the sign that stands for a cut.
ODD = rf"[{WHITE}] |\x00"
#: A piece that every pattern leaves whole, so that it needs no pattern.
PLAIN = "^ ?[A-Za-z]+$"
#: Pieces whose ids are held.
HELD = 1_000_000
_ENCODERS: dict = {}


def place(name: str) -> str:
    """A tokenizer file by its path, or by its name among the public ones."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """With `added`, the added tokens' strings in a text are their ids, as by default in the library; without, they are ordinary text."""

    def __init__(self, name: str, cuts: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(place(name))
        self.tokenizer.encode_special_tokens = not added
        strings = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        # in any case of letters, as some are looked for in lower-cased text
        self.whole = "(?i)" + "|".join(map(re.escape, strings)) if strings else None
        self.holds = re.compile(self.whole).search if strings else lambda text: None
        self.cuts, self.spaced = CUTS[cuts], cuts == "byte"
        self.simple = self._without_pattern(name)
        self.values, self.ids, self.begin, self.used, self.turn = None, np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, np.int64), 0

    def _without_pattern(self, name: str):
        """The tokenizer without its pattern, for pieces of plain letters; itself where that would change their ids."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        out = Tokenizer.from_file(place(name))
        out.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        if out.normalizer is not None:
            out.normalizer = normalizers.Lowercase()
        some = ["a", "The", "quick", "Zurich", "SHOUTED", "unbelievableness", *([" lazy", " Dogs"] if self.spaced else [])]
        same = all(out.encode(x, add_special_tokens=False).ids == self.tokenizer.encode(x, add_special_tokens=False).ids for x in some)
        return out if same else self.tokenizer

    def _encoded(self, new) -> list[list[int]]:
        """The ids of each piece of an Arrow array."""
        import pyarrow.compute as pc

        plain = pc.match_substring_regex(new, PLAIN).to_numpy(zero_copy_only=False)
        out: list = [None] * len(new)
        for tokenizer, here in ((self.simple, plain), (self.tokenizer, ~plain)):
            got = tokenizer.encode_batch_fast(new.filter(here).to_pylist(), add_special_tokens=False)
            for k, e in zip(np.flatnonzero(here).tolist(), got, strict=True):
                out[k] = e.ids
        return out

    def look_up(self, distinct) -> np.ndarray:
        """Where the ids of distinct pieces (an Arrow array) are held: piece k has ids[begin[k] : begin[k + 1]]. The rest of them is encoded."""
        import pyarrow as pa
        import pyarrow.compute as pc

        self.turn += 1
        if self.values is None:
            self.values = pa.array([], pa.string())
        at = pc.index_in(distinct, value_set=self.values)
        if len(self.values) + at.null_count > HELD:
            self._forget()
            at = pc.index_in(distinct, value_set=self.values)
        fresh = at.is_null().to_numpy(zero_copy_only=False)
        at = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        if fresh.any():
            new = distinct.filter(fresh)
            got = self._encoded(new)
            at[fresh] = len(self.values) + np.arange(len(new))
            size = np.fromiter(map(len, got), np.int64, len(got))
            self.values = pa.concat_arrays([self.values, new])
            self.begin = np.append(self.begin, self.begin[-1] + np.cumsum(size))
            self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(got), "<u4", int(size.sum())))
            self.used = np.append(self.used, np.zeros(len(new), np.int64))
        self.used[at] = self.turn
        return at

    def _forget(self) -> None:
        """Half of what may be held stays, by last use."""
        keep = np.sort(np.argsort(self.used, kind="stable")[max(0, len(self.used) - HELD // 2) :])
        size = np.diff(self.begin)
        self.ids = self.ids[np.repeat(np.isin(np.arange(len(size)), keep), size)]
        self.values, self.used, self.begin = self.values.take(keep), self.used[keep], np.append(0, np.cumsum(size[keep]))

    def _cut(self, texts):
        """An Arrow array of texts as lists of pieces, and which texts are left out of it."""
        import pyarrow.compute as pc

        if not self.spaced:
            texts = pc.replace_substring_regex(texts, EDGE, r"\1 \2")
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " "), np.zeros(len(texts), bool)
        odd = pc.match_substring_regex(texts, ODD)
        texts = pc.replace_substring_regex(pc.if_else(odd, "", texts), EDGE, "\\1\x00\\2")
        texts = pc.replace_substring_regex(texts, FEED, "\\1\x00\n\x00\\2")
        return pc.split_pattern(pc.replace_substring(texts, " ", "\x00 "), "\x00"), odd.to_numpy(zero_copy_only=False)

    def pieces(self, texts) -> tuple[list[tuple], np.ndarray]:
        """An Arrow array of texts without nulls as groups (rows, their edges among the pieces, distinct pieces, number of each piece), and the rows
        that are to be encoded whole."""
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False) if self.whole else np.zeros(len(texts), bool)
        lists, odd = self._cut(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts)
        groups = [(np.flatnonzero(~odd & ~whole), lists)]
        if odd.any():
            groups[0] = (groups[0][0], lists.filter(pa.array(~odd & ~whole)))
            groups.append((np.flatnonzero(odd), pa.array([self.cuts.findall(x) for x in texts.filter(pa.array(odd)).to_pylist()], pa.list_(pa.string()))))
        elif whole.any():
            groups[0] = (groups[0][0], lists.filter(pa.array(~whole)))
        out = []
        for rows, some in groups:
            edges = some.offsets.to_numpy().astype(np.int64)
            coded = some.flatten().dictionary_encode()
            out.append((rows, edges - edges[0], coded.dictionary, coded.indices.to_numpy()))
        return out, np.flatnonzero(whole)

    def encode(self, texts) -> list[np.ndarray]:
        """The ids of each text of an Arrow array or a list (null: none), as 32-bit integers."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        groups, whole = self.pieces(texts)
        out: list = [None] * len(texts)
        for rows, edges, distinct, code in groups:
            at = self.look_up(distinct)
            begin, size = self.begin[at][code], (self.begin[at + 1] - self.begin[at])[code]
            ends = np.append(0, np.cumsum(size))
            laid = self.ids[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
            for k, a, z in zip(rows.tolist(), ends[edges[:-1]].tolist(), ends[edges[1:]].tolist(), strict=True):
                out[k] = laid[a:z]
        for k in whole.tolist():
            out[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, "<u4")
        return out

    def spans(self, texts: list[str]) -> list[np.ndarray]:
        """First character, and the one after the last, of each token of each text: two columns."""
        return [np.array(e.offsets, np.int64).reshape(-1, 2) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


def encoder(name: str, cuts: str) -> Encoder:
    """One for each worker process, with the library's defaults."""
    key = (name, cuts)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(name, cuts, added=True)
    return _ENCODERS[key]


def slices(batch, chars: int = 8_000_000) -> Iterator:
    """An Arrow batch with a text column, in slices of about so many characters, so that memory doesn't follow the batch's size."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    at = 0
    group = np.cumsum(lengths) // chars
    for k in np.flatnonzero(np.diff(group)) + 1:
        yield batch.slice(at, k - at)
        at = int(k)
    if at < batch.num_rows:
        yield batch.slice(at)
