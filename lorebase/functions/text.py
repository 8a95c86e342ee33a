"""Text functions: Spark expressions, and plain Python where a scan over lines is needed."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import col

#: Fixed value: what counts as white space at the ends of a text.
SPACE = r"[\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def full_trim(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(x), f"^{SPACE}+", ""), f"{SPACE}+$", "")


def collapse(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(x), r"\s+", " "))


def format_bytes(n: Column | str) -> Column:
    """Binary units with one decimal from KB up."""
    x = col(n).cast("double")
    out = F.format_string("%d B", col(n).cast("long"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(x >= 1024.0**k, F.format_string(f"%.1f {unit}", x / 1024.0**k)).otherwise(out)
    return out


def like_escape(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"([\\%_])", r"\\$1")


def markdown_escape(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"([\\`*_\[\]<>])", r"\\$1")


def xml_unescape(x: Column | str) -> Column:
    out = col(x)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def strip_anchors(x: Column | str) -> Column:
    """A heading without the {/*id*/} or {#id} behind it."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(x), r"\s*\{/\*.*?\*/\}\s*$", ""), r"\s*\{#[^}]*\}\s*$", ""))


def fence(x: Column | str) -> Column:
    """A fence longer than any run of backticks in the text, three at least."""
    runs = F.transform(F.regexp_extract_all(col(x), F.lit(r"(`+)"), 1), lambda r: F.length(r))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def fences_balanced(x: Column | str) -> Column:
    return F.regexp_count(col(x), F.lit("```")) % 2 == 0


def excerpt(line: Column | str, at: Column, width: int = 200) -> Column:
    """A window of ``width`` characters with the match (1-based place ``at``) about a quarter in; dots where it cuts."""
    x, n = col(line), F.length(col(line))
    start = F.greatest(F.lit(1), F.least(at - width // 4, n - width + 1))
    cut = F.concat(F.when(start > 1, F.lit("…")).otherwise(F.lit("")), F.substring(x, start, F.lit(width)), F.when(start + width - 1 < n, F.lit("…")).otherwise(F.lit("")))
    return F.when(n <= width, x).otherwise(cut)


def tokens(x: Column | str) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(col(x)), F.lit(r"([\p{L}\p{N}]+)"), 1)


# --- plain Python ----------------------------------------------------------------------------------------------


def fold(text: str) -> str:
    """Lower-cased, without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


_WORD = re.compile(r"[^\W_]+")


def search_tokens(text: str) -> list[str]:
    """Folded and stemmed tokens, as the index holds them."""
    return [stem(w) for w in _WORD.findall(fold(text))]


def phrases(query: str) -> list[str]:
    """The parts of a user's query: quoted phrases and words, then the whole as one phrase first if there are several. Operators are words."""
    parts, now, quoted = [], "", False
    for c in query:
        if c == '"':
            if now.strip():
                parts.append(now.strip())
            now, quoted = "", not quoted
        elif c.isspace() and not quoted:
            if now:
                parts.append(now)
            now = ""
        else:
            now += c
    if now.strip():
        parts.append(now.strip())
    if len(parts) < 2:
        return parts
    return [" ".join(parts), *parts]


def _measure(w: str) -> int:
    """Vowel-consonant sequences of a stem (Porter's m)."""
    kinds = re.sub("v+", "v", re.sub("c+", "c", "".join("v" if _vowel(w, i) else "c" for i in range(len(w)))))
    return kinds.removeprefix("c").count("vc")


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _has_vowel(w: str) -> bool:
    return any(_vowel(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and not _vowel(w, n - 1) and _vowel(w, n - 2) and not _vowel(w, n - 3) and w[-1] not in "wxy"


#: The rules of steps 2, 3 and 4 of Porter's published algorithm.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    """Porter's stemmer for ASCII words; others and short ones stay."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        for rule in sorted(rules.split(), key=lambda r: -len(r.partition(":")[0])):
            end, _, new = rule.partition(":")
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in sorted(_STEP4.split(), key=len, reverse=True):
        if w.endswith(end):
            head = w[: -len(end)]
            if _measure(head) > 1 and (end != "ion" or head.endswith(("s", "t"))):
                w = head
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w
