"""Text normalizers as Column functions.

The normalizers differ on purpose: which one a title or a line went through
decides whether the two match.  None of them is idempotent in general.

Character classes follow Python's: a word character is a letter, a number or
`_` in any script; white space includes the separators U+001C to U+001F.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

WORD = r"[\p{L}\p{N}_]"
SPACE = r"(?U)[\s\x1c-\x1f]+"
_REPEATED = rf"({WORD})\1+"

#: Pairs of lines that a page break inside a heading tears apart.
SPLIT_HEADINGS = (
    ("REQUISITOS DE PARTICIPACIÓN Y CRITERIOS DE", "EVALUACIÓN"),
    ("SUMINISTROS REQUERIDOS - ESPECIFICACIONES", "TÉCNICAS"),
)
#: Doubled marks that are halved once, in this order.
DOUBLED_MARKS = ("--", ",,", "..", ";;", "::", "°°", "//")
#: Fixed value: what a subtitle looks like (an upper-case letter first, no digits).
SUBTITLE = r"^[A-ZÁÉÍÓÚ](?:[a-záéíóúA-ZÁÉÍÓÚ]|(?U)\s|[^\p{L}\p{N}_])*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_repeats(c: Column | str) -> Column:
    """Runs of one word character become one: `aaBB²²` -> `aB²`."""
    return F.regexp_replace(_col(c), _REPEATED, "$1")


def squeeze(c: Column | str) -> Column:
    """White-space runs become one blank, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), SPACE, " "))


def clean_canonical(c: Column | str) -> Column:
    out = collapse_repeats(c)
    for double, single in (("--", "-"), ("::", ":"), ("..", ".")):
        out = F.replace(out, F.lit(double), F.lit(single))
    return squeeze(F.regexp_replace(out, ",+", ","))


def clean_bulk(c: Column | str) -> Column:
    """Repeats and white space only."""
    return squeeze(collapse_repeats(c))


def clean_outline(c: Column | str) -> Column:
    """White space only; null becomes empty."""
    return F.coalesce(squeeze(c), F.lit(""))


def clean_blanking(c: Column | str) -> Column:
    """Repeats collapse; doubled marks, commas and white space become a blank each."""
    return F.trim(F.regexp_replace(collapse_repeats(c), r"(?U)--|::|\.\.|,+|[\s\x1c-\x1f]+", " "))


def halve_marks(c: Column | str) -> Column:
    out = _col(c)
    for mark in DOUBLED_MARKS:
        out = F.replace(out, F.lit(mark), F.lit(mark[0]))
    return out


def _lines(c: Column | str) -> Column:
    return F.split(_col(c), "\n", -1)


def _changed(lines: Column) -> Column:
    return F.filter(lines, lambda x, i: (i == 0) | (x != F.get(lines, F.greatest(i - 1, F.lit(0)))))


def has_consecutive_duplicates(c: Column | str) -> Column:
    """Null has none."""
    lines = _lines(c)
    return F.coalesce(F.size(_changed(lines)) < F.size(lines), F.lit(False))


def drop_consecutive_duplicates(c: Column | str) -> Column:
    return F.array_join(_changed(_lines(c)), "\n")


def is_uppercase(c: Column | str) -> Column:
    """At least one cased letter and no lower- or title-case one (letters alone count)."""
    letters = F.regexp_replace(_col(c), r"[^\p{L}]", "")
    upper = letters.rlike(r"\p{IsUppercase}") & ~letters.rlike(r"[\p{IsLowercase}\p{Lt}]")
    return F.coalesce(upper, F.lit(False))


def strip_controls(c: Column | str) -> Column:
    """Null becomes empty; control characters go but tab and line ends; line ends become \\n."""
    kept = F.regexp_replace(_col(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.coalesce(F.regexp_replace(kept, r"\r\n?", "\n"), F.lit(""))


def strip_all_controls(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"[\x00-\x1f\x7f]", "")


def strip_nul(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit("\x00"), F.lit(""))


@pandas_udf(T.StringType())
def _decomposed_ascii(s: pd.Series) -> pd.Series:
    s = s.str.replace(r"[\x00-\x1f\x7f-\x9f]", "", regex=True).str.normalize("NFKD")
    s = s.str.replace(r"[^\x00-\x7f]", " ", regex=True)
    return s.str.replace(r"\s+", " ", regex=True).str.strip()


def deep_clean(c: Column | str) -> Column:
    """ASCII only: accents come apart and every other code point becomes a blank (needs NFKD, so a pandas UDF)."""
    return _decomposed_ascii(_col(c))


@pandas_udf(T.ArrayType(T.StringType()))
def _element_texts(html: pd.Series, tag: pd.Series, closed: pd.Series) -> pd.Series:
    import re
    from html.entities import html5
    from html.parser import HTMLParser

    class Texts(HTMLParser):
        def __init__(self, name: str):
            super().__init__(convert_charrefs=True)
            self.name, self.depth, self.found = name, 0, []

        def handle_starttag(self, tag, attrs):
            if tag == self.name:
                self.found.append("")
                self.depth += 1

        def handle_endtag(self, tag):
            if tag == self.name and self.depth:
                self.depth -= 1

        def handle_data(self, data):
            if self.depth:
                self.found[-1] += data.strip()

    def reference(m):
        """As it is if it is closed; else with an ampersand that comes out as one."""
        rest = m[1] or ""
        return m[0] if rest.startswith("#") or rest in html5 else f"&amp;{rest}"

    may_be_closed = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)?")

    def texts(x, name, only_closed):
        if x is None:
            return None
        parser = Texts(name)
        parser.feed(may_be_closed.sub(reference, x) if only_closed else x)
        parser.close()
        return parser.found

    return pd.Series([texts(x, t, c) for x, t, c in zip(html, tag, closed, strict=True)])


def element_texts(html: Column | str, tag: str = "h3", closed: bool = False) -> Column:
    """Texts of the elements of a tag, entities decoded, text nodes stripped and joined.

    Like browsers it also decodes some entities that lack their semicolon (`&amp`); with `closed` these stay as they are.
    """
    return _element_texts(_col(html), F.lit(tag), F.lit(closed))


def is_subtitle(c: Column | str, exclude: tuple[str, ...] = ()) -> Column:
    shape = _col(c).rlike(SUBTITLE)
    return shape & ~_col(c).isin(*exclude) if exclude else shape


#: Normalizers by name, for operators that take one as an argument.
NORMALIZERS: dict[str, Callable[[Column | str], Column]] = {
    "canonical": clean_canonical,
    "bulk": clean_bulk,
    "outline": clean_outline,
    "blanking": clean_blanking,
    "identity": _col,
}
