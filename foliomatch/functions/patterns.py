"""Regular expressions that mean the same to Java's engine and to RE2, so that the Spark expressions and
the SQL they are tested against share them."""

import re

from foliomatch import config as C

THAI = r"\x{0E00}-\x{0E7F}"
SPACE = r"[\s\p{Z}]"
NOT_WORD = rf"[^\p{{L}}\p{{N}}_{THAI}]"
BLANK = r"[ \t\x0B\f\r]"
NOT_WORD_NOR_BLANK = rf"[^\p{{L}}\p{{N}}_{THAI} \t\x0B\f\r]"
PAD_ZERO = ((rf"^(\p{{Nd}})([{THAI}])", 2), (rf"([{THAI}])(\p{{Nd}})$", 2), (rf"([{THAI}])(\p{{Nd}})([{THAI}])", 3))
# What counts as a word, day of a month, Buddhist year, number, time and date.
TOKEN = r"[^ \t\n\x0B\f\r]+"
DAY = r"^0?[1-9]$|^[12]\p{Nd}$|^3[01]$"
BE_YEAR = r"^25\p{Nd}{2}$"
INTEGER = r"^[+-]?\p{Nd}+(?:_\p{Nd}+)*$"
DECIMAL = r"^[+-]?(?:\p{Nd}+\.\p{Nd}*|\.\p{Nd}+)$"
NUMBER = r"^-?\p{Nd}+\.?\p{Nd}*$"
TIME = rf"(\p{{Nd}}{{1,2}})[.:](\p{{Nd}}{{2}})(?:{SPACE}*(?:น\.?|u\.?))?"
NUMERIC_DATE = r"(\p{Nd}{1,2})[/\-](\p{Nd}{1,2})[/\-](\p{Nd}{4})"


def any_of(words) -> str:
    return "|".join(re.escape(w).replace(r"\ ", " ") for w in words)


MONTH_DATES = tuple((rf"(\p{{Nd}}{{1,2}}){SPACE}*[/\-]?{SPACE}*{any_of([m])}{SPACE}*[/\-]?{SPACE}*(\p{{Nd}}{{4}})", f"{i % 12 + 1:02d}") for i, m in enumerate(C.MONTHS))
LABEL_INSIDE = any_of([w for w in C.LABELS_PARTIAL if len(w) >= 4])
LABEL_START = f"^(?:{any_of(C.LABEL_PREFIXES)})"
