"""Personal data in text.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod 97 for account
numbers, ranges for addresses) and words nearby raise or lower the score. Base spans are those of the
fixed patterns and always stay; the method adds account numbers, and phone, national and card numbers of
looser form whose score reaches the threshold.
"""
import bisect
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import whole

# Base kinds in their order, then the kinds the method adds.
KINDS = ("email", "ip", "card", "phone", "iban", "national", "loose_phone")
BASE = KINDS[:4]
RANK = {kind: i for i, kind in enumerate(KINDS)}
THRESHOLD = 0.6
NEAR = 40  # characters looked at before and after a span

# Words that make a kind likelier, and words that speak of something else.
FOR = {
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta", "transfer"),
    "national": ("ssn", "social security", "national id", "passport", "personal id"),
    "loose_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "móvil", "appel"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
}
AGAINST = ("isbn", "order", "invoice", "version", "page", "article", "serial", "build", "issn", "figure")

# A start that a digit precedes would have been found from that digit, so the look-behinds change no match; they keep long runs linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOOSE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def mod97(account: str) -> bool:
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _small(part: str) -> bool:
    """Whether a run of digits is at most 255, with any number of zeros before it."""
    rest = part.lstrip("0")
    return len(rest) <= 3 and int(rest or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Left of each @ the longest run of address characters after the last match, right of it a domain."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns."""
    out = [(a, b, "email") for a, b in _emails(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(_small(p) for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = _digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return out


def score(text: str, start: int, end: int, kind: str, confirmed: bool) -> float:
    """Half for the form, more for a passed check; words nearby move it by a quarter either way."""
    near = text[max(0, start - NEAR):start].lower() + " " + text[end:end + NEAR].lower()
    value = 0.75 if confirmed else 0.45
    if any(w in near for w in FOR.get(kind, ())):
        value += 0.25
    if any(w in near for w in AGAINST):
        value -= 0.25
    return max(0.0, min(1.0, value))


def _union(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The stretches that the spans cover together, apart from each other and in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((a, b) for a, b, _ in spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def added_spans(text: str, base: list[tuple[int, int, str]], threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    """Spans that the fixed patterns do not have, none of them over a base span."""
    found = []
    for m in IBAN.finditer(text):
        parts = m.group().replace(" ", "")
        if 15 <= len(parts) <= 34:
            found.append((m.start(), m.end(), "iban", mod97(parts)))
    for m in NATIONAL.finditer(text):
        area, group, serial = m.group().split("-")
        found.append((m.start(), m.end(), "national", area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"))
    found += [(m.start(), m.end(), "loose_phone", False) for m in LOOSE.finditer(text)]
    for m in CARD.finditer(text):
        digits = _digits(m.group())
        if 12 <= len(digits) <= 13 and luhn(digits):  # the short forms clash with other numbers: only context lets them pass
            found.append((m.start(), m.end(), "card", False))
    taken = _union(base)
    out = []
    for start, end, kind, confirmed in found:
        if kind in ("iban", "national") and not confirmed:
            continue
        at = bisect.bisect_left(taken, (end,))  # those before it begin before the end; they are apart, so the last one ends last
        if (not at or taken[at - 1][1] <= start) and score(text, start, end, kind, confirmed) >= threshold:
            taken.insert(at, (start, end))
            out.append((start, end, kind))
    return out


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], RANK[s[2]])))


def find_pii(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_<base kind>, n_added, n_spans (all of them), base_sha256 and spans of each row of ``documents``.

    A null text is empty and has no spans. Every row is read alone, from its whole text: ties, repeated
    rows, extra columns and empty tables change nothing. Places are in code points, ends exclusive.
    """
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for text in part.column(1).to_pylist():
                base = base_spans(text)
                more = added_spans(text, base, threshold)
                kinds = [k for *_, k in base]
                rows.append((*[kinds.count(k) for k in BASE], len(more), len(base) + len(more), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(base + more)))
            made = pd.DataFrame(rows, columns=[*[f"n_{k}" for k in BASE], "n_added", "n_spans", "base_sha256", "spans"])
            whole_batch = [part.column(0), *[pa.array(made[c], pa.int64() if c.startswith("n_") else pa.string()) for c in made.columns]]
            yield pa.RecordBatch.from_arrays(whole_batch, ["doc_id", *made.columns])

    counts = ", ".join(f"n_{k} bigint" for k in (*BASE, "added", "spans"))
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole().alias("text")).mapInArrow(batches, f"doc_id bigint, {counts}, base_sha256 string, spans string")
