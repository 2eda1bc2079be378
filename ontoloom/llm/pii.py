"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, digits, plus signs, URL schemes and cues such as "iban" or
"street". Each anchor is handed to a deterministic local parser that finds where the entity begins and ends and validates it.

Base kinds (email, ip, card, phone) have the boundaries of the patterns in ``KINDS``' comment, leftmost and not overlapping
within a kind. The method adds: url (a scheme and what follows), account (an identifier after a cue, or an IBAN that passes
mod 97) and address (house number, capitalised names and a street word).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.batches import emit, slices

# Fixed values. Base patterns:
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+          ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), parts to 255
#   card  [0-9]([\x20-]?[0-9])+, 16 to 19 digits, Luhn               phone \+[0-9][\x20().0-9-]+[0-9], 8 to 15 digits
KINDS = ("email", "ip", "card", "phone", "url", "account", "address")
BASE = KINDS[:4]
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("iban", "account", "acct", "passport", "ssn", "tax id", "routing")
STREETS = (" street", " avenue", " road", " boulevard", " lane", " straße", " strasse")
_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LOCAL, _HOST, _PHONE = _ALNUM | set("._%+-"), _ALNUM | {"-"}, _DIGITS | set(" ().-")
_URL_END = frozenset(" \t\n\r\x0b\x0c<>\"'`{}|\\^")


@lru_cache(1)
def _automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    words = [("@", "email"), ("+", "phone")]
    words += [(d, "digit") for d in _DIGITS] + [(s, "url") for s in SCHEMES] + [(c, "account") for c in CUES] + [(s, "address") for s in STREETS]
    for word, kind in words:
        machine.add_word(word, (kind, len(word)))
    machine.make_automaton()
    return machine


def _forward(text: str, at: int, allowed: frozenset) -> int:
    while at < len(text) and text[at] in allowed:
        at += 1
    return at


def email_at(text: str, at: int, free: int) -> tuple[int, int] | None:
    """The address around the at-sign at ``at``; nothing before ``free`` may be used."""
    start = at
    while start > free and text[start - 1] in _LOCAL:
        start -= 1
    end = _forward(text, at + 1, _HOST)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in _HOST:
        end, labels = _forward(text, end + 1, _HOST), labels + 1
    return (start, end) if labels else None


def ips_from(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """Dotted quads of the dotted digit runs that begin at ``at``, valid or not, and where the runs end."""
    parts, end = [], at
    while True:
        stop = _forward(text, end, _DIGITS)
        parts.append((end, stop))
        if stop + 1 < len(text) and text[stop] == "." and text[stop + 1] in _DIGITS:
            end = stop + 1
        else:
            break
    return [(parts[i][0], parts[i + 3][1]) for i in range(0, len(parts) - 3, 4)], stop


def valid_ip(quad: str) -> bool:
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in quad.split(".")))


def digits_from(text: str, at: int) -> int:
    """End of digits that single spaces or hyphens may part."""
    while True:
        at = _forward(text, at, _DIGITS)
        if at + 1 < len(text) and text[at] in " -" and text[at + 1] in _DIGITS:
            at += 1
        else:
            return at


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def phone_at(text: str, at: int) -> int | None:
    """End of the number after the plus sign at ``at``: a digit, then at least one more sign, then a last digit."""
    if at + 1 >= len(text) or text[at + 1] not in _DIGITS:
        return None
    end = _forward(text, at + 2, _PHONE)
    while end > at + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    return end if end > at + 3 and text[end - 1] in _DIGITS else None


def iban(code: str) -> bool:
    if not (15 <= len(code) <= 34 and code.isascii() and code[:2].isalpha() and code[2:4].isdigit() and code.isalnum()):
        return False
    return int("".join(str(int(c, 36)) for c in (code[4:] + code[:4]).upper())) % 97 == 1


def account_after(text: str, at: int) -> tuple[int, int] | None:
    """The identifier that follows a cue ending at ``at``: up to three signs and words like "no." between; an IBAN or six digits at least."""
    start = at
    for word in ("", " number", " no", " nr"):
        if text[at : at + len(word)].lower() == word:
            start = at + len(word)
    skipped = 0
    while start < len(text) and skipped < 4 and text[start] in " :#.=":
        start, skipped = start + 1, skipped + 1
    end = start
    # 34 signs are the longest code; a longer run is none
    while end < len(text) and end - start < 70 and (text[end] in _ALNUM or text[end] in " -" and end + 1 < len(text) and text[end + 1] in _ALNUM and any(c in _DIGITS for c in text[end + 1 : end + 5])):
        end += 1
    code = "".join(c for c in text[start:end] if c in _ALNUM)
    return (start, end) if iban(code) or sum(c in _DIGITS for c in code) >= 6 and len(code) <= 34 else None


def address_before(text: str, at: int, end: int) -> tuple[int, int] | None:
    """House number and one to four capitalised words before a street word that spans ``at`` to ``end``."""
    if end < len(text) and text[end].isalpha():
        return None
    start, names = at, 0
    while start > 0 and names <= 4:
        stop = start
        while start > 0 and text[start - 1] not in " \n\t":
            start -= 1
        word = text[start:stop]
        if word and word[0] in _DIGITS and len(word) <= 6 and names:
            return start, end
        if not word or not word[0].isupper():
            return None
        names += 1
        if start == 0 or text[start - 1] != " ":
            return None
        start -= 1
    return None


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of everything found, by kind as in ``KINDS``, then start. Ends are exclusive, in code points."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    free = dict.fromkeys((*KINDS, "digit"), 0)
    ip_done = card_done = 0
    low = text if text.islower() and text.isascii() else text.encode().lower().decode()
    for last, (kind, size) in _automaton().iter(low):
        at = last - size + 1
        if kind == "digit":
            if at >= ip_done:
                quads, ip_done = ips_from(text, at)
                found["ip"] += [q for q in quads if valid_ip(text[q[0] : q[1]])]
            if at >= card_done:
                card_done = digits_from(text, at)
                if card_done - at >= 16:
                    digits = text[at:card_done].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append((at, card_done))
        elif kind == "email":
            if span := email_at(text, at, free[kind]):
                found[kind].append(span)
                free[kind] = span[1]
        elif kind == "phone":
            if at >= free[kind] and (end := phone_at(text, at)):
                free[kind] = end
                if 8 <= sum(c in _DIGITS for c in text[at:end]) <= 15:
                    found[kind].append((at, end))
        elif kind == "url":
            if at < free[kind]:  # within the one before, which ran to the end of its signs
                continue
            run = last + 1
            while run < len(text) and text[run] not in _URL_END:
                run += 1
            end = run
            while end > last + 1 and text[end - 1] in ".,;:!?)":
                end -= 1
            free[kind] = run
            if end > last + 1:
                found[kind].append((at, end))
        else:
            whole = at == 0 or not text[at - 1].isalnum() or kind == "address"
            span = whole and (account_after(text, last + 1) if kind == "account" else address_before(text, at, last + 1))
            if span and span[0] >= free[kind]:
                found[kind].append(span)
                free[kind] = span[1]
    return [(k, *s) for k in KINDS for s in found[k]]


_ROW = pa.schema([("doc_id", pa.int64())] + [(f"n_{k}", pa.int64()) for k in BASE] + [("base_sha256", pa.string()), ("spans", pa.string())])


def digest(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        out: dict[str, list] = {n: [] for n in _ROW.names}
        for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            found = spans(text or "")
            base = [s for s in found if s[0] in BASE]
            out["doc_id"].append(doc_id)
            for kind in BASE:
                out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
            out["base_sha256"].append(hashlib.sha256(digest(base).encode()).hexdigest())
            out["spans"].append(digest(found))
        yield emit(_ROW, **out)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row, of whole texts.

    A null text is empty and has no spans. Rows stand alone, so ties, repeats and empty tables need nothing special.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        texts = []
        for text in part.column("text").to_pylist():
            out, at = [], 0
            for kind, a, b in sorted(spans(text or ""), key=lambda s: (s[1], -s[2])):
                if a >= at:
                    out += [(text or "")[at:a], f"<{kind}>"]
                    at = b
            texts.append(None if text is None else "".join(out) + text[at:])
        yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(texts, type=pa.string()))


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """The same rows and columns with each span of text replaced by its kind in angle brackets."""
    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(_masked, docs.withColumn("text", F.col("text").cast("string")).schema)
