"""Secret scans: keywords found by an Aho-Corasick automaton, anchored patterns only near hits, then checksums.

One automaton over the text with A-Z lower-cased finds all keywords. Runs of hexadecimal digits have no
keyword; they are found by the same means in the text folded to classes, where a digit of them is one symbol
and the least run is the keyword. Each rule then tries its pattern anchored at a hit, or, for keys that have
no prefix of their own, at the words that follow a hit within a fixed distance. A rule's hits are taken from
left to right and those inside its last match are passed over, which gives just the leftmost matches that do
not overlap, as if the pattern had been searched through the whole text.

Rules base on contracts (assign, access, hex) report what matches. The others know a key format with a
checksum inside and report a match only if the checksum holds: CRC-32 in base 62 (github, npm), Base58Check
(wif, xprv), CRC-16 in base 32 (stellar), Bech32 (age, nostr).

Defined cases: a null text is empty and has no spans; each row is scanned by itself, so repeated rows, ids
that are null or equal, and extra columns of any name change nothing; an empty table gives no rows. A text of
any length is one string in one task, with a few folded copies of it; spans count code points.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from base64 import b32decode
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, bound_batches, map_rows, table

HEX_LEAST = 24
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_CLASSES = bytes(0x68 if c in b"0123456789abcdef" else 0x2E for c in range(128)) + bytes(range(128, 256))  # h: a digit
#: Alphabets of the checksummed formats.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_STEPS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


# -- checksums ---------------------------------------------------------------------------------------


def crc32_base62(key: str) -> bool:
    """The last six characters are the CRC-32 of what stands between the prefix and them."""
    body, check = key.split("_", 1)[1][:-6], 0
    for c in key[-6:]:
        check = check * 62 + BASE62.index(c)
    return check == zlib.crc32(body.encode())


def base58check(key: str) -> bool:
    """Base 58 of a payload and the first four bytes of its double SHA-256."""
    n = 0
    for c in key:
        n = n * 58 + BASE58.index(c)
    raw = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return len(raw) > 4 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def crc16_base32(key: str) -> bool:
    """Base 32 of a payload and its CRC-16 (polynomial 0x1021), low byte first."""
    raw, crc = b32decode(key), 0
    for byte in raw[:-2]:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x1021 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc == int.from_bytes(raw[-2:], "little")


def bech32(key: str) -> bool:
    """Human-readable part, 1, data and a checksum of 30 bits, all of one case."""
    if key not in (key.lower(), key.upper()):
        return False
    head, _, data = key.lower().rpartition("1")
    values = [ord(c) >> 5 for c in head] + [0] + [ord(c) & 31 for c in head] + [BECH32.index(c) for c in data]
    state = 1
    for v in values:
        top, state = state >> 25, (state & 0x1FFFFFF) << 5 ^ v
        for i, step in enumerate(BECH32_STEPS):
            state ^= step if top >> i & 1 else 0
    return state == 1


# -- rules -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """``pattern`` is tried where one of ``keywords`` (lower case) begins; with ``reach``, at each place up to so many characters
    behind one, where a word begins. ``valid`` looks at the match."""

    kind: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    valid: Callable[[re.Match], bool]
    reach: int = 0


def _checked(test: Callable[[str], bool]) -> Callable[[re.Match], bool]:
    return lambda m: test(m[0])


#: Listed in the order in which spans at one place are reported. The first three are the base; ``hex`` has no keywords.
RULES = [
    Rule("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[1]) >= 6),
    Rule("access", ("akia",), re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    Rule("hex", (), re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= HEX_LEAST),
    Rule("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile("gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9_])"), _checked(crc32_base62)),
    Rule("npm", ("npm_",), re.compile("npm_[A-Za-z0-9]{36}(?![A-Za-z0-9_])"), _checked(crc32_base62)),
    Rule("xprv", ("xprv",), re.compile(f"xprv[{BASE58}]{{107}}(?![A-Za-z0-9])"), _checked(base58check)),
    Rule("wif", ("wif", "private", "privkey", "wallet"), re.compile(f"[5KL][{BASE58}]{{50,51}}(?![A-Za-z0-9])"), _checked(base58check), 48),
    Rule("stellar", ("stellar", "seed", "private"), re.compile("S[A-Z2-7]{55}(?![A-Za-z0-9])"), _checked(crc16_base32), 48),
    Rule("age", ("age-secret-key-1",), re.compile(f"(?:age-secret-key-1[{BECH32}]{{58}}|AGE-SECRET-KEY-1[{BECH32.upper()}]{{58}})(?![A-Za-z0-9])"), _checked(bech32)),
    Rule("nostr", ("nsec1",), re.compile(f"nsec1[{BECH32}]{{58}}(?![A-Za-z0-9])"), _checked(bech32)),
]
BASE = ("assign", "access", "hex")
_KINDS = [r.kind for r in RULES]
_WORD = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]")


@cache
def automata():
    """Of all keywords, with the numbers of the rules that have each, and of the least run of hexadecimal digits."""
    import ahocorasick

    words, runs, rules = ahocorasick.Automaton(), ahocorasick.Automaton(), {}
    for n, rule in enumerate(RULES):
        for k in rule.keywords:
            rules.setdefault(k, []).append(n)
    for k, ns in rules.items():
        words.add_word(k, (len(k), tuple(ns)))
    runs.add_word("h" * HEX_LEAST, HEX_LEAST)
    words.make_automaton()
    runs.make_automaton()
    return words, runs


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words, runs = automata()
    found: list[tuple[int, int, str]] = []
    free = [0] * len(RULES)  # where a rule's last match ends; it starts no other before that

    def attempt(n: int, start: int) -> None:
        if start >= free[n] and (m := RULES[n].pattern.match(text, start)):
            free[n] = m.end()
            if RULES[n].valid(m):
                found.append((start, m.end(), RULES[n].kind))

    waiting: dict[int, tuple[int, int]] = {}  # rules with reach: places still to be tried, as neighbouring reaches overlap
    for end, (length, ns) in words.iter(raw.translate(_LOWER).decode("utf-8", "surrogatepass")):
        for n in ns:
            if not RULES[n].reach:
                attempt(n, end + 1 - length)
                continue
            since = max(end + 1, waiting.get(n, (0, 0))[1])
            until = end + 1 + RULES[n].reach
            for m in _WORD.finditer(text, since, until):
                attempt(n, m.start())
            waiting[n] = (since, until)
    hexes = _KINDS.index("hex")
    for end, length in runs.iter(raw.translate(_CLASSES).decode("utf-8", "surrogatepass")):
        attempt(hexes, end + 1 - length)
    return sorted(found, key=lambda s: (s[0], _KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_secrets(documents: DataFrame) -> DataFrame:
    """doc_id, kind, start, end: a row for each secret of each document."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_rows(rows, lambda part: ((i, kind, a, b) for i, t in part for a, b, kind in find_spans(t)), "doc_id long, kind string, start long, end long")


def redact_secrets(documents: DataFrame, mark: str = "<secret>") -> DataFrame:
    """All columns of the documents, with each secret of ``text`` replaced by ``mark``; spans that overlap become one mark."""

    def masked(text: str) -> str:
        out, at = [], 0
        for start, end, _ in find_spans(text):
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(masked, na_action="ignore")

    bound_batches(documents.sparkSession)
    return documents.withColumn("text", mask(F.col("text").cast("string")))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, from all spans of its whole text."""

    def digest(part: list[tuple]):
        for doc_id, text in part:
            spans = find_spans(text)
            base = [s for s in spans if s[2] in BASE]
            n = [sum(s[2] == kind for s in base) for kind in BASE]
            yield (doc_id, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))

    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_rows(rows, digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
