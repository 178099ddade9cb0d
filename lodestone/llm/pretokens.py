"""Tokenizing through caches of pre-tokens, exact for byte-level BPE files of the tokenizers library.

A byte-level BPE never merges across pre-tokens, and its pre-tokenizer always starts one at a space that a
character other than white space follows. A text is therefore cut at such spaces and at single newlines, and each
piece is looked up before the library is asked. Of a run of blanks, newlines and tabs all but the last one are a pre-token, and
the last one, unless it is a blank, is another; a run that ends the text is one. Texts that hold other white space next to
such a place, or the string of an added token, go to the library whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain, count, islice

import numpy as np

_RUN = re.compile(r"[ \n\t\r]{2,}|[\t\r]|^[ \n]|[ \n]\Z")
_MARKS = ("  ", "\n\n", " \n", "\n ", "\t", "\r")  # a text without these, and without white space at its ends, has no run
_LAST_SAFE = "ɏ"  # up to here all Unicode versions agree on what is a letter
_CLOSING = ".,;:!?"


@cache
def tokenizer(path: str):
    """One tokenizer for each worker and file. Its own threads stay off: Spark gives the parallelism."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Bounded(dict):
    """A cache of two generations: when the younger is full it becomes the elder, and hits there are brought back."""

    def __init__(self, make, limit: int, pinned: dict | None = None):
        super().__init__()
        self.make, self.limit, self.elder, self.pinned = make, limit, {}, pinned or {}

    def __missing__(self, key):
        value = self.pinned.get(key)
        if value is None:
            value = self.elder.get(key)
            if value is None:
                value = self.make(key)
            if len(self) >= self.limit:
                self.elder = dict(self)
                self.clear()
        if len(self) < self.limit:
            self[key] = value
        return value


def splits_into_pretokens(path: str) -> bool:
    """Whether a tokenizers file is of the kind that this module can cut up."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kind, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec.get("added_tokens", []))
    return bool(
        kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space")
        and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        and spec.get("normalizer") is None and spec.get("post_processor") is None and plain
    )


def byte_symbols() -> list[str]:
    """The printable character that byte-level BPE uses for each byte: printable ones stand for themselves, the others follow from 256."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class _Uncut(Exception):
    """The text has white space where a cut would not be exact."""


class PretokenEncoder:
    """Maps texts to values gathered from their pre-tokens.

    ``of_ids`` turns a list of ids into the value kept (a count, or packed ids); ``total`` joins values.
    ``pinned`` holds values of frequent pre-tokens, known beforehand; ``limit`` bounds each cache's entries.
    """

    def __init__(self, path: str, of_ids, total, pinned: dict | None = None, limit: int = 250_000):
        self.tok, self.of_ids, self.total = tokenizer(path), of_ids, total
        self.model = self.tok.model
        self.symbols = dict(enumerate(byte_symbols()))
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.pretokens = _Bounded(self._of_pretoken, limit, pinned)
        self.pieces = _Bounded(self._of_piece, limit)
        self.cuttable = splits_into_pretokens(path)

    def _of_pretoken(self, text: str):
        return self.of_ids([t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.symbols))])

    def whole(self, text: str):
        return self.of_ids(self.tok.encode(text, add_special_tokens=False).ids)

    def _of_piece(self, piece: str):
        """piece: what followed a space; with a newline in front, what followed that; with '\\0' in front, text without a space
        before it; with '\\1' in front, white space that is a pre-token."""
        mark, body = piece[:1], piece
        if mark == "\1":
            return self.pretokens[piece[1:]]
        if mark in "\0\n":
            body = piece[1:]
        if not body or body[0].isspace() or body[-1].isspace():
            raise _Uncut
        if mark == "\0":
            return self.whole(body)
        core = body.rstrip(_CLOSING)
        if not core.isalpha() or max(core) > _LAST_SAFE:
            return self.whole(("\n" if mark == "\n" else " ") + body)
        parts = [self.pretokens["\n"], self.pretokens[core]] if mark == "\n" else [self.pretokens[" " + core]]
        if len(core) < len(body):
            parts.append(self.pretokens[body[len(core) :]])
        return self.total(parts)

    def value(self, text: str | None):
        if not text:
            return self.total([])
        if not self.cuttable or "\0" in text or "\1" in text or any(a in text for a in self.added):
            return self.whole(text)
        try:
            return self.total(list(map(self.pieces.__getitem__, self._pieces(text))))
        except _Uncut:
            return self.whole(text)

    @staticmethod
    def _pieces(text: str) -> list[str]:
        """What followed spaces, newlines (marked) and the start (marked); runs of white space are marked as pre-tokens of their own."""
        if not (text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _MARKS)):
            pieces = text.replace("\n", " \n").split(" ")
            pieces[0] = "\0" + pieces[0]
            return pieces
        out, at, lead = [], 0, "\0"
        for run in [*_RUN.finditer(text), None]:
            begin, end = run.span() if run else (len(text), len(text))
            if begin > at:
                pieces = text[at:begin].replace("\n", " \n").split(" ")
                pieces[0] = lead + pieces[0]
                out += pieces
            if run:
                head, tail = (run[0], "") if end == len(text) else (run[0][:-1], run[0][-1])
                out += ["\1" + x for x in (head, tail.strip(" ")) if x]
                lead = "" if tail == " " else "\0"
                at = end
        return out


class PieceIds:
    """Ids of many texts at once: each distinct piece has a number, and the ids of all pieces lie in one array.

    The library is given the new pieces of a run of texts in one call, each as an input of its own; where the ids of each end follows from their bytes.
    Beyond ``limit`` pieces the most used half stays.
    """

    def __init__(self, path: str, limit: int = 500_000):
        self.single, self.limit = PretokenEncoder(path, list, None, None, 1), limit
        self.tok = self.single.tok
        vocab = self.tok.get_vocab()
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():  # a symbol for each byte; added tokens don't occur in pieces
            self.n_bytes[i] = len(token)
        self.numbers: dict[str, int] = defaultdict(count().__next__)
        self.ids, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.bad, self.starts, self.uses = np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def _string(piece: str) -> str:
        """The text that a piece, as ``PretokenEncoder._pieces`` marks it, stands for."""
        return piece if piece[:1] == "\n" else piece[1:] if piece[:1] in ("\0", "\1") else " " + piece

    def _encode(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all strings, one after the other, and how many each has."""
        ids = np.array(self.tok.encode_batch_fast([strings], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
        wanted = np.cumsum(np.fromiter(map(len, map(str.encode, strings)), np.int64, len(strings)))
        found = np.cumsum(self.n_bytes[ids])
        at = np.searchsorted(found, wanted)
        if len(found) and found[-1] == wanted[-1] and (found[at] == wanted).all():
            return ids, np.diff(at, prepend=-1)
        each = [self.single.whole(s) for s in strings]  # a vocabulary without some bytes
        return np.array([i for x in each for i in x], np.uint32), np.array(list(map(len, each)), np.int64)

    def _learn(self, pieces: list[str]) -> None:
        bodies = [p[1:] if p[:1] in ("\0", "\n") else p for p in pieces]
        bad = [p[:1] != "\1" and (not b or b[0].isspace() or b[-1].isspace()) for p, b in zip(pieces, bodies, strict=True)]
        ids, sizes = [self.ids], [self.sizes]
        for lo in range(0, len(pieces), 1 << 14):
            # what can't be cut there is never used
            some = self._encode(["a" if b else self._string(p) for p, b in zip(pieces[lo : lo + (1 << 14)], bad[lo : lo + (1 << 14)], strict=True)])
            ids.append(some[0])
            sizes.append(some[1])
        self.ids, self.sizes = np.concatenate(ids), np.concatenate(sizes)
        self.bad = np.concatenate([self.bad, np.array(bad, bool)])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after the other, and where those of each end."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[numbers] - ends + sizes, sizes)], ends

    def _forget(self) -> None:
        half = self.limit // 2
        stay = np.sort(np.argpartition(-self.uses, half)[:half])
        kinds = list(self.numbers)
        self.numbers = defaultdict(count(half).__next__, zip(map(kinds.__getitem__, stay.tolist()), range(half)))
        self.ids, _ = self._gather(stay)
        self.sizes, self.bad, self.uses = self.sizes[stay], self.bad[stay], self.uses[stay] // 2
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _some(self, texts: list[str]) -> list[np.ndarray]:
        cut = self.single.cuttable
        lists = [PretokenEncoder._pieces(t) if cut and t and not ("\0" in t or "\1" in t or any(a in t for a in self.single.added)) else [] for t in texts]
        if len(self.numbers) > self.limit:
            self._forget()
        numbers = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(lists)), np.int64)
        if new := len(self.numbers) - len(self.sizes):
            self._learn(list(islice(reversed(self.numbers), new))[::-1])
        self.uses = np.bincount(numbers, minlength=len(self.sizes)) + np.pad(self.uses, (0, new))
        flat, ends = self._gather(numbers)
        ends, bad = np.append(0, ends), np.append(0, np.cumsum(self.bad[numbers]))
        last = np.cumsum([len(x) for x in lists])
        out = []
        for text, pieces, to in zip(texts, lists, last.tolist(), strict=True):
            since = to - len(pieces)
            if text and (not pieces or bad[to] > bad[since]):
                out.append(np.array(self.single.whole(text), np.uint32))
            else:
                out.append(flat[ends[since] : ends[to]])
        return out

    def of_texts(self, texts: list[str | None], most_chars: int = 1 << 20) -> Iterator[np.ndarray]:
        """The ids of each text, null taken as empty; runs of texts of about ``most_chars`` characters are looked up together."""
        run, held = [], 0
        for text in texts:
            run.append(text or "")
            held += len(run[-1])
            if held >= most_chars:
                yield from self._some(run)
                run, held = [], 0
        if run:
            yield from self._some(run)
