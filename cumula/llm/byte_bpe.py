"""Byte-level BPE by parts: cuts no pre-token lies across, and what the library makes of a part."""

from __future__ import annotations

import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

CUT = re.compile(r"(?<=\S) (?=\S)")


def parts(text: str) -> list[str]:
    """Text cut at every single space between two characters that are not white space.

    The pattern of byte-level BPE lets only a pre-token's first character be a
    space, so none lies across such a cut. All parts but the first stand
    behind a space, which belongs to them.
    """
    found = text.split(" ")
    if any(not p or p[0].isspace() or p[-1].isspace() for p in found):
        return CUT.split(text)
    return found


class ByteBpe:
    """A tokenizer file; added special strings inside texts are tokens, as by the library's default."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def pretokens(self, part: str) -> list[str]:
        """Pre-tokens of a part in order; a special string is one."""
        out = []
        for k, s in enumerate(self.special.split(part) if self.special else [part]):
            if k % 2:
                out.append(s)
            elif s:
                out += [s[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(s)]
        return out

    def ids(self, batch: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]


_OPEN: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """The tokenizer of a path, opened once in a worker."""
    if path not in _OPEN:
        _OPEN[path] = ByteBpe(path)
    return _OPEN[path]
