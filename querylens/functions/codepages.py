"""Decoding and encoding of text as column expressions; a row that can't be converted gets null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Encoding names and their aliases, lower case, with hyphens.
ALIASES = {
    "utf-8": ("utf-8", "utf8"),
    "iso-8859-1": ("iso-8859-1", "iso8859-1", "latin-1", "latin1"),
    "windows-1252": ("windows-1252", "windows1252", "cp1252", "cp-1252"),
}


def _pairs() -> tuple[str, str]:
    """The bytes 0x80 to 0x9F that windows-1252 gives a character, as Latin-1 controls and as those characters."""
    pairs = []
    for b in range(0x80, 0xA0):
        try:
            pairs.append((chr(b), bytes([b]).decode("cp1252")))
        except UnicodeDecodeError:
            continue
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


CONTROLS, PRINTED = _pairs()


def encoding_name(name: str) -> str:
    """The encoding that a name or alias stands for; ValueError if none."""
    plain = name.lower().replace("_", "-")
    for known, aliases in ALIASES.items():
        if plain in aliases:
            return known
    raise ValueError(f"unknown encoding: {name}")


def decoded(content: Column, encoding: str) -> Column:
    """Text of binary ``content``; null where it isn't valid UTF-8. Both 8-bit encodings decode as windows-1252 does."""
    if encoding_name(encoding) == "utf-8":
        return F.try_validate_utf8(content.cast("string"))
    return F.translate(F.decode(content, "ISO-8859-1"), CONTROLS, PRINTED)


def encoded(text: Column, encoding: str) -> Column:
    """Binary of ``text``; null where a character has no byte in the encoding."""
    if encoding_name(encoding) == "utf-8":
        return F.encode(text, "UTF-8")
    undefined = "".join(chr(b) for b in range(0x80, 0xA0) if chr(b) not in CONTROLS)
    allowed = "[\\x{0}-\\x{7F}\\x{A0}-\\x{FF}" + undefined + PRINTED + "]*"
    ok = F.regexp_like(text, F.lit("\\A" + allowed + "\\z"))
    return F.when(ok, F.encode(F.translate(F.when(ok, text), PRINTED, CONTROLS), "ISO-8859-1"))
