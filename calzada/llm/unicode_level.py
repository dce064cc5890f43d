"""Brings this interpreter's Unicode tables to the level of the tokenizer libraries.

The regex module knows letters and numbers that the libraries' tables do not have yet; str.lower() lacks case
pairs that they do have.
"""

from __future__ import annotations

import regex

# Code points that are letters or numbers for the regex module and neither for the libraries.
NEWER = [
    (0x0558, 0x0558), (0x058B, 0x058C), (0x088F, 0x088F), (0x0C5C, 0x0C5C), (0x0CDC, 0x0CDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
# Capitals that str.lower() leaves alone, first of a run, how many, and their first small letter.
CAPITALS = [
    (0x1C89, 1, 0x1C8A), (0xA7CB, 1, 0x0264), (0xA7CC, 1, 0xA7CD), (0xA7CE, 1, 0xA7CF), (0xA7D2, 1, 0xA7D3), (0xA7D4, 1, 0xA7D5),
    (0xA7DA, 1, 0xA7DB), (0xA7DC, 1, 0x019B), (0x10D50, 22, 0x10D70), (0x16EA0, 25, 0x16EBB),
]
newer = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER) + "]")
lowered = {a + i: b + i for a, n, b in CAPITALS for i in range(n)}
SYMBOL = ""


def latin(text: str) -> bool:
    """Only code points below 256, which all tables agree on; a fast test."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def find_all(pattern: regex.Pattern, text: str) -> list[str]:
    """``pattern.findall``, with the newer letters and numbers taken as symbols."""
    if latin(text):
        return pattern.findall(text)
    masked, n = newer.subn(SYMBOL, text)
    return [text[m.start():m.end()] for m in pattern.finditer(masked)] if n else pattern.findall(text)


def lower(text: str) -> str:
    """Each character by itself; str.lower() would look around a capital sigma."""
    return text.lower() if latin(text) else text.translate(lowered).replace("Σ", "σ").lower()
