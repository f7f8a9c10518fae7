"""Small made-up inputs for operators whose licensed originals are not at hand."""

from __future__ import annotations

SAMPLE_DICTIONARY = "%\n1\tmotion\n2\tplace\n3\tfunction\n4\tmind\n%\nthe\t3\na\t3\nriver\t2\nrive*\t1\nharbour\t2\nmini*\t2\t4\nlaunch*\t1\nproof\t4\nre*\t1\nreport\t4\nquiet*\t4\nover*\t1\t2\n"


def _line(numbers: dict[tuple[int, int], int], flag: str, kind: str, codes: str, word: str) -> str:
    line = [" "] * 43
    for (a, b), value in numbers.items():
        line[a:b] = str(value).rjust(b - a)
    return "".join(line) + flag + kind + kind + codes.ljust(5) + word + "|XX|"


#: Lines of a fixed-width word norm file; the second entry of "river" replaces the first.
NORM_LINES = [
    _line({(0, 2): 5, (2, 4): 4, (4, 5): 2, (5, 10): 165, (25, 28): 545}, " ", "N", " S   ", "RIVER"),
    _line({(0, 2): 5, (2, 4): 4, (4, 5): 2, (5, 10): 166, (28, 31): 610}, "Q", "N", " S  Z", "RIVER"),
    _line({(0, 2): 7, (4, 5): 2, (5, 10): 12}, " ", "N", "HA C ", "HARBOUR"),
    _line({(0, 2): 3, (5, 10): 69971}, " ", "J", "   C ", "THE"),
    _line({(0, 2): 2, (5, 10): 6742}, " ", "J", "A$O P", "NO"),
    _line({(0, 2): 9, (4, 5): 3}, " ", "P", "P B N", "REPAIRED"),
    _line({(0, 2): 9, (4, 5): 3, (40, 43): 412}, " ", "V", "S Z Y", "REPAIRED"),
    _line({(0, 2): 5}, " ", "A", "MR  B", "QUIETLY"),
]
