"""Words and stems in DuckDB's SQL, for the oracles; nothing here uses the library's own functions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Ranges with compatibility forms of letters and digits that the test tables may hold.
RANGES = ((0xA0, 0x250), (0x2070, 0x2190), (0x2460, 0x2500), (0xFB00, 0xFB07), (0xFF00, 0xFFEF), (0x1D400, 0x1D800))


@lru_cache(maxsize=1)
def _forms() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(characters, their one-character forms, longer forms); accents are DuckDB's own business."""
    one, to, longer = [], [], []
    for c in (chr(code) for a, b in RANGES for code in range(a, b)):
        form = unicodedata.normalize("NFKD", c)
        if form == unicodedata.normalize("NFD", c) or "'" in form:
            continue
        if len(form) == 1:
            one.append(c)
            to.append(form)
        elif any(x.isalnum() for x in form):
            longer.append((c, form))
    return "".join(one), "".join(to), tuple(longer)


def sql_words(text: str) -> str:
    """SQL for the runs of letters and digits of a text without accents, in lower case."""
    one, to, longer = _forms()
    out = f"translate(coalesce({text}, ''), '{one}', '{to}')"
    whole = out
    for c, form in longer:
        whole = f"replace({whole}, '{c}', '{form}')"
    some = "".join(c for c, _ in longer)
    out = f"CASE WHEN regexp_matches({text}, '[{some}]') THEN {whole} ELSE {out} END"
    return f"regexp_extract_all(lower(strip_accents({out})), '[\\p{{L}}\\p{{N}}]+')"


def sql_stem(source: str, word: str = "word", into: str = "term") -> str:
    """SQL that adds the stem of ``word`` to the rows of ``source``, a stage per subquery."""
    a = f"""SELECT *, CASE WHEN length({word}) <= 3 THEN {word} WHEN {word} LIKE '%sses' THEN left({word}, length({word}) - 2)
      WHEN {word} LIKE '%ies' AND length({word}) > 4 THEN left({word}, length({word}) - 3) || 'y'
      WHEN {word} LIKE '%s' AND NOT regexp_matches({word}, '[sui]s$') THEN left({word}, length({word}) - 1) ELSE {word} END AS s1 FROM ({source})"""
    b = f"""SELECT *, CASE WHEN length(s1) > 5 AND s1 LIKE '%ing' THEN left(s1, length(s1) - 3)
      WHEN length(s1) > 4 AND (s1 LIKE '%ed' OR s1 LIKE '%ly') THEN left(s1, length(s1) - 2) ELSE s1 END AS s2 FROM ({a})"""
    c = f"SELECT *, CASE WHEN length(s2) > 3 AND s2 LIKE '%e' THEN left(s2, length(s2) - 1) ELSE s2 END AS s3 FROM ({b})"
    return f"""SELECT * EXCLUDE (s1, s2, s3), CASE WHEN length(s3) > 3 AND right(s3, 1) = substr(s3, length(s3) - 1, 1)
      AND right(s3, 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN left(s3, length(s3) - 1) ELSE s3 END AS {into} FROM ({c})"""
