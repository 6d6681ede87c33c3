"""Units of a text that byte-level BPE and piece BPE encode alone: words with the single space or line feed before them.

The byte-level pre-tokenizer never puts such a space or line feed in one piece with what stands before it, and no entry of the piece vocabulary holds a
space, or a line feed at all, behind another character. So a text may be parted before every single space between a character that is
no space and one that is no white space, and before every line feed between one that is neither and one that is no white space: the tokens of the parts are those of the
text. Texts repeat their words, so each part is encoded once for each worker and looked up from then on.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_CUT = re.compile(r"(?<=[^ ]) (?=\S)|(?<=[^ \n])(?=\n\S)")
#: Units that a Python worker keeps, and characters that it learns; beyond either it starts anew.
CACHED_UNITS, CACHED_CHARACTERS = 1_500_000, 48_000_000
#: Longer units are encoded each time that they come.
LONG = 256


class _Known(dict):
    """unit -> value; notes the units that it lacks, and parts that aren't units."""

    def __init__(self):
        super().__init__()
        self.missing, self.odd = [], False

    def __missing__(self, unit: str) -> None:
        body = unit[1:] if unit[:1] == "\n" else unit
        if not body or body[0].isspace():
            self.odd = True
        else:
            self.missing.append(unit)


class Units:
    """Values of units by `learn(units) -> values`, which are looked up once they are known. `forget` is called when all are dropped."""

    def __init__(self, learn: Callable[[list[str]], list], forget: Callable[[], None] | None = None):
        self.learn, self.forget, self.known, self.characters = learn, forget, _Known(), 0

    def values(self, texts: list[str]) -> list[list]:
        """The values of a space and each text, unit by unit in order. `learn` gets units with their first space or line feed."""
        known = self.known
        if len(known) > CACHED_UNITS or self.characters > CACHED_CHARACTERS:
            known.clear()
            self.characters = 0
            if self.forget:
                self.forget()
        look, out, open_ = known.__getitem__, [], {}
        lacking: dict[str, object] = {}
        for i, text in enumerate(texts):
            parts, known.odd = text.replace("\n", " \n").split(" "), False
            got = list(map(look, parts))
            if known.odd:
                known.missing.clear()
                parts = _CUT.split(text)
                if not parts[0] or parts[0][0].isspace():
                    parts[0] = f" {parts[0]}"
                got = [known.get(p) for p in parts]
                known.missing += [p for p, v in zip(parts, got, strict=True) if v is None]
            if known.missing:
                lacking.update(dict.fromkeys(known.missing))
                known.missing.clear()
                open_[i] = parts
            out.append(got)
        if lacking:
            new = list(lacking)
            for a in range(0, len(new), 4096):
                part = new[a : a + 4096]
                lacking.update(zip(part, self.learn([u if u[0] in " \n" else f" {u}" for u in part]), strict=True))
            for i, parts in open_.items():
                out[i] = [lacking[p] if v is None else v for p, v in zip(parts, out[i], strict=True)]
            self.characters += sum(map(len, lacking))
            known.update({u: v for u, v in lacking.items() if len(u) <= LONG and u[0] != " "})
        return out


_tokenizers: dict[str, object] = {}


def byte_tokenizer(name_or_path: str, plain_specials: bool):
    """A byte-level tokenizer of the tokenizers library, one per worker. plain_specials: strings of special tokens are ordinary text."""
    key = f"{name_or_path} {plain_specials}"
    if key not in _tokenizers:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(place(name_or_path))
        t.no_padding()
        t.no_truncation()
        t.encode_special_tokens = plain_specials
        _tokenizers[key] = t
    return _tokenizers[key]


def place(name_or_path: str) -> str:
    """A vocabulary's file: a path, or the name of a public one."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def head(text: str) -> str:
    """The text's first unit."""
    cut = _CUT.search(text)
    return text[: cut.start()] if cut else text
