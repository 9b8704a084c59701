"""Personal data: candidate spans from generous generators, chosen by boosted trees on their form and context.

Spans of BASE patterns with their checks always stand. Beyond them, generators propose overlapping candidates (other forms of addresses and
numbers, secrets); gradient-boosted trees over format and context features give each a chance, a threshold for each kind, calibrated
on held-out examples for PRECISION, selects them, and of overlapping ones the likeliest stays, of equally likely ones the longest, then the first. No table
has labelled spans, so the trees are trained on examples made from formats and contexts by a fixed seed, and calibrated on examples of other words,
cues and separators; no document is read for it. A kind without a threshold is an error.

Spans are in code points, end exclusive. Handling: null texts are empty; null ids pass through; repeated rows give equal rows; an empty table gives an
empty result; further columns are kept by redact_documents() and not read by scan(), whatever their names; a text is read whole, however long.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import math
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbdt, scratch, textkit

KINDS = ("email", "ip", "card", "phone", "secret", "id", "iban")
PRECISION = 0.99
AROUND = 24

# The base patterns, with a look behind where a match can't start later in the same run.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches that pass their checks; leftmost, not overlapping within a kind."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((a, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if not _DIGIT.search(text):
        return out
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# Generators: what could be personal data at all. Possessive repeats keep each linear in the text.
_AT = re.compile(r" ?[\[(]at[\])] ?| at ")
_MASKED = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?: ?[\[(]dot[\])] ?| dot |\.)[A-Za-z0-9-]{2,63}){1,5}")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])(?:\+|\()?[0-9](?:[ ().-]{0,2}[0-9]){6,24}(?![0-9A-Za-z])")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+={0,2}+(?![A-Za-z0-9+/_=-])")
_SIGNED = re.compile(r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")
_PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+-----END [A-Z ]{0,40}PRIVATE KEY-----")
_NAMED = re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|passphrase|secret|api[_-]?key|access[_-]?key|auth[_-]?token)[\"']? ?(?:=|:|is) ?[\"']?([^\s\"',;]{6,}+)")
_DOTTED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])")
_COLONS = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:.])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: A text without any of these has neither a base span nor a candidate. For pyarrow's expressions, which read a text once.
SUSPECT = r"[0-9@]| at |[(\[]at|::|eyJ|-----BEGIN|(?i:password|passwd|pwd|passphrase|secret|api[_-]?key|access[_-]?key|auth[_-]?token)"


def _ipv6(s: str) -> bool:
    try:
        return s != "::" and bool(ipaddress.IPv6Address(s))
    except ValueError:
        return False


def _mod97(s: str) -> bool:
    """The check of international account numbers."""
    t = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of everything that a generator proposes; overlapping."""
    out = []
    for m in _AT.finditer(text):
        a = m.start()
        while a > max(0, m.start() - 64) and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start() and (d := _MASKED.match(text, m.end())):
            out.append((a, 0, d.end()))
    out += [(m.start(1), 4, m.end(1)) for m in _NAMED.finditer(text)]
    if "eyJ" in text:
        out += [(m.start(), 4, m.end()) for m in _SIGNED.finditer(text)]
    if "-----BEGIN" in text:
        out += [(m.start(), 4, m.end()) for m in _PEM.finditer(text)]
    if ":" in text:
        out += [(m.start(), 1, m.end()) for m in _COLONS.finditer(text) if _ipv6(m[0])]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _DOTTED.finditer(text)]
        for m in _NUMBER.finditer(text):
            out += [(m.start(), kind, m.end()) for kind in (2, 3, 5)]
        out += [(m.start(), 4, m.end()) for m in _TOKEN.finditer(text) if _DIGIT.search(m[0])]
        out += [(m.start(), 6, m.end()) for m in _IBAN.finditer(text)]
    return out


# Words before a span that speak for or against a kind.
CUES = (
    ("mail", "contact", "write", "reach"), ("ip", "host", "server", "address", "client"), ("card", "visa", "credit", "payment", "debit"), ("phone", "tel", "call", "mobile", "fax", "whatsapp"),
    ("token", "key", "secret", "password", "bearer", "api", "auth", "pwd", "passwd", "passphrase"), ("ssn", "passport", "license", "id", "social", "tax"),
    ("iban", "account", "bank", "transfer", "konto", "deposit"), ("version", "release", "v", "build", "section", "chapter"),
    ("order", "invoice", "isbn", "total", "page", "issue", "no", "ref", "item", "sku"), ("date", "year", "on", "since", "between", "from", "until"),
)
_WORD = re.compile(r"[A-Za-z]+")


_BEFORE = re.compile(r"(?i)(?:password|passwd|pwd|passphrase|secret|api[_-]?key|access[_-]?key|auth[_-]?token)[\"']? ?(?:=|:|is) ?[\"']?$")


def _named(text: str, start: int) -> bool:
    """Whether what stands before says that a secret follows."""
    return bool(_BEFORE.search(text[max(0, start - AROUND) : start]))


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    s, before, after = text[start:end], text[max(0, start - AROUND) : start], text[end : end + 2]
    n = len(s)
    digits = _digits(s)
    letters = sum(c.isalpha() for c in s)
    words = [w.lower() for w in _WORD.findall(before)][-4:]
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(s).values())
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False))
    return [
        *[float(kind == k) for k in range(len(KINDS))],
        n, len(digits), letters, len(groups), max(groups, default=0), min(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0,
        entropy, switches / n, s.count("-"), s.count("."), s.count(" "), s.count("("), float(s[0] == "+"), float(s[0] == "0"),
        float(len(digits) > 1 and luhn(digits)), float(len(set(digits)) / max(len(digits), 1)), float(all(c in "0123456789abcdefABCDEF" for c in s)), float(any(c.isupper() for c in s) and any(c.islower() for c in s)),
        float(groups[:1] == [4] and 1900 <= int(digits[:4] or 0) <= 2099), float(all(len(g) < 4 and int(g) <= 255 for g in re.findall(r"[0-9]+", s))),
        float(before[-1:] in "\"'=:"), float(before.rstrip(" \"'")[-1:] in ("=", ":")), float(before[-1:] in ("$", "€", "#", "%", "/")), float(after[:1] in ("%", "/", ":", "€")),
        s.count(":"), float(s.startswith("eyJ") and s.count(".") == 2), float(s.startswith("-----BEGIN")), float(kind == 1 and ":" in s), float(kind == 6 and _mod97(s)), float(_named(text, start)),
        groups[1] if len(groups) > 1 else 0, float(kind == 2 and 14 <= len(digits) <= 19 and luhn(digits)), float(kind == 5 and groups == [3, 2, 4]), float(kind == 3 and len(digits) > 9 and groups != [3, 2, 4]), float(max(groups, default=0) == min(groups, default=0) == 4),
        s.count("/"), s.count("_"), s.count("+"), sum(c.isupper() for c in s) / n, sum(c in "aeiouy" for c in s) / n, float(after[:1] == "." and after[1:2].isalnum()), float(before[-1:] == "."),
        *[float(any(w in cue for w in words)) for cue in CUES],
    ]


@dataclass
class Model:
    trees: gbdt.Trees
    threshold: np.ndarray

    def spans(self, text: str, base: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int]]:
        """The base spans and the candidates chosen beside them, by start and kind."""
        base = base_spans(text) if base is None else base
        taken = sorted((a, b) for a, _, b in base)
        found = [c for c in candidates(text) if not any(a < c[2] and c[0] < b for a, b in taken)] if len(taken) < 64 else _apart(candidates(text), taken)
        if not found:
            return base
        chance = self.trees.probability(np.array([features(text, *c) for c in found]))
        chosen: list[tuple[int, int, int]] = []
        busy: list[tuple[int, int]] = []
        for i in np.lexsort((np.arange(len(found)), [a - b for a, _, b in found], -np.round(chance, 2))).tolist():
            a, kind, b = found[i]
            if chance[i] < self.threshold[kind]:
                continue
            if not _touches(busy, a, b):
                chosen.append(found[i])
                _insert(busy, a, b)
        return sorted(base + chosen)


def _touches(busy: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether [a, b) overlaps one of the sorted disjoint spans."""
    k = bisect.bisect_left(busy, (b, -1))
    return k > 0 and busy[k - 1][1] > a


def _insert(busy: list[tuple[int, int]], a: int, b: int) -> None:
    bisect.insort(busy, (a, b))


def _apart(found, taken):
    busy: list[tuple[int, int]] = []
    for a, b in taken:
        if busy and a < busy[-1][1]:
            busy[-1] = busy[-1][0], max(b, busy[-1][1])
        else:
            busy.append((a, b))
    return [c for c in found if not _touches(busy, c[0], c[2])]


def examples(seed: int = 7, n: int = 9000, other: bool = False) -> list[tuple[str, tuple[int, int, int], int]]:
    """(text, candidate, label) made from formats and contexts: what a generator proposes on made sentences, labelled by how they were made.
    other: with other words, cues, separators and lengths, for calibration."""
    r = random.Random(seed)
    letters, vowels = ("bcdfghklmnprstvw", "aeiou") if not other else ("bdjklmnpqrtvxz", "aeioy")
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    syllable = lambda: r.choice(letters) + r.choice(vowels) + r.choice(("", r.choice(letters)))
    word = lambda: "".join(syllable() for _ in range(r.randint(1, 4)))
    of = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    hexa, base64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def card() -> str:
        body = r.choice("3456") + number(r.choice((14, 14, 14, 13)))
        whole = next(body + d for d in "0123456789" if luhn(body + d))
        return r.choice((".", "  ", " - ") if not other else (". ", "--", "  ")).join(whole[i : i + 4] for i in range(0, len(whole), 4))

    def masked() -> str:
        local = r.choice((word(), f"{word()}.{word()}", f"{word()}{number(2)}", f"{word()}_{word()}", f"{of('abcdefghij', 1)}.{word()}"))
        at, dot = r.choice((" at ", "[at]", " (at) ", "(at)", " [at] ")), r.choice((" dot ", "[dot]", "(dot)", ".", " [dot] ", " (dot) "))
        return local + at + word() + dot + r.choice((f"{word()}{dot}", "")) + r.choice(("com", "org", "net", "de", "io", "edu") if not other else ("co", "info", "fr", "uk"))

    def ipv6() -> str:
        groups = [of(hexa, r.randint(1, 4)) for _ in range(8)]
        if r.random() < 0.5:
            k = r.randint(1, 4)
            return ":".join(groups[:k]) + "::" + ":".join(groups[k : k + r.randint(1, 3)])
        return ":".join(groups)

    def iban() -> str:
        country, body = r.choice(("DE", "FR", "GB", "NL", "CH") if not other else ("ES", "IT", "AT", "BE")), number(r.choice((16, 18, 20)))
        whole = country + f"{98 - int(body + ''.join(str(int(c, 36)) for c in country) + '00') % 97:02}" + body
        return r.choice((whole, " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))))

    def named() -> str:
        return r.choice((word() + number(r.randint(1, 4)), of(base64 + "!$%*?#", r.randint(8, 20)), f"{word()}-{word()}{number(1)}", word().title() + number(2) + "!"))

    def token() -> str:
        return r.choice((of(hexa, r.choice((32, 40, 64, 128) if not other else (36, 48, 96))), "sk-" + of(base64, 32), "AKIA" + of(base64[:26] + "0123456789", 16), "ghp_" + of(base64, 36), of(base64 + "+/", r.choice((40, 64, 88, 700))), "xoxb-" + number(11) + "-" + of(base64, 24)))

    signed = lambda: "eyJ" + ".".join(of(base64 + "_-", r.randint(20, 80)) for _ in range(3))
    pem = lambda: f"-----BEGIN {(k := r.choice(('', 'RSA ', 'EC ', 'OPENSSH ')))}PRIVATE KEY-----\n" + "\n".join(of(base64 + "+/", 64) for _ in range(r.randint(1, 4))) + f"\n-----END {k}PRIVATE KEY-----"
    key = lambda: r.choice(("password", "Password", "pwd", "secret", "api_key", "API-KEY", "passphrase") if not other else ("passwd", "auth_token", "access_key", "PASSWORD", "apikey")) + r.choice((": ", "=", " = ", ' is ', '="', '": "'))
    phone = lambda: r.choice((f"({number(3)}) 555-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"{number(3)}.{number(3)}.{number(4)}", f"0{number(2)} {number(4)} {number(4)}", f"({number(3)}) {number(3)}-{number(4)}", f"0{number(3)} {number(6)}"))
    dates = lambda: r.choice((f"{r.randint(1900, 2099)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1900, 2030)} - {r.randint(1900, 2030)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2099)}", f"{r.randint(1900, 2099)}-{r.randint(10, 12)}-{r.randint(10, 28)} {r.randint(10, 23)}"))
    # kind, what it is, the cue before it (a row of CUES, or what names a secret)
    good = ((0, masked, 0), (1, ipv6, 1), (2, card, 2), (3, phone, 3), (4, token, 4), (4, named, None), (4, signed, 4), (4, pem, 4), (5, lambda: f"{number(3)}-{number(2)}-{number(4)}", 5), (6, iban, 6))
    bad = (
        (0, lambda: f"{word()} at {word()}", None), (0, lambda: f"{word()} at {word()}. {word().title()} {word()}", None), (0, lambda: f"{word()} at {word()}.{number(1)}", 7), (0, lambda: f"{number(2)} at {word()} dot {word()}", 8),
        (1, lambda: ".".join(str(r.randint(0, 12)) for _ in range(4)), 7), (1, lambda: ".".join(str(r.randint(256, 999)) for _ in range(4)), 7), (1, lambda: ":".join(f"{r.randint(0, 59):02}" for _ in range(3)), 9),
        (2, lambda: number(r.choice((12, 13, 16, 18))), 8), (3, dates, 9), (3, lambda: number(r.choice((7, 8, 9, 10, 12))), 8), (5, lambda: f"{number(4)}-{number(4)}", 8), (3, lambda: f"{number(1)},{number(3)} {number(3)} {number(3)}", 8),
        (4, lambda: f"{word()}-{word()}-{word()}-{r.randint(1, 99)}", 7), (4, lambda: number(r.choice((16, 18, 20, 24))), 8), (4, lambda: f"{word()}/{word()}/{word()}_{number(1)}", 8), (4, lambda: f"{word()}_{word()}_{word()}{number(1)}", None),
        (6, lambda: f"{of('ABCDEFGHJK', 2)}{number(2)} {of(base64[:26], 4)} {of(base64[:26], 4)} {number(4)}", 8),
    )
    out: list[tuple[str, tuple[int, int, int], int]] = []
    while len(out) < n:
        is_good = r.random() < 0.55
        kind, make, cue = r.choice(good) if is_good else r.choice(bad)
        if make is named:
            hint = key()
        elif cue is not None and r.random() < 0.6:
            hint = r.choice(CUES[cue]) + r.choice((" ", ": ", ' = "', " is ") if not other else (" ", " - ", "=", " was "))
        else:
            hint = word() + r.choice((" ", ", ", " ("))
        own = make()
        text = f"{word()} {word()} {hint}"
        a = len(text)
        text += own + r.choice(('"', " ", ".", ",", "")) + f" {word()} {word()}"
        if is_good and any(s <= a and e >= a + len(own) for s, _, e in base_spans(text)):
            continue  # it stands already
        for c in candidates(text):
            if c[0] < a + len(own) and a < c[2]:
                whole = c[0] <= a + 1 and c[2] >= a + len(own) - 1
                out.append((text, c, int(is_good and whole and c[1] == kind)))
    return out


_fitted: list[Model] = []


def model() -> Model:
    """The trees, fitted once in a process, with a threshold for each kind."""
    if not _fitted:
        made = examples()
        x, y = np.array([features(t, *c) for t, c, _ in made]), np.array([label for _, _, label in made], np.float64)
        trees = gbdt.fit(x, y, trees=80, depth=5)
        _fitted.append(Model(trees, np.array([t for _, t, _, _ in calibration(trees)])))
    return _fitted[0]


def calibration(trees: gbdt.Trees, precision: float = PRECISION) -> list[tuple[str, float, float, float]]:
    """(kind, threshold, precision, recall) on held-out examples: the lowest threshold, 0.5 at least, from which so many are right."""
    made = examples(11, 6000, other=True)
    chance, y = trees.probability(np.array([features(t, *c) for t, c, _ in made])), np.array([label for _, _, label in made])
    kind, out = np.array([c[1] for _, c, _ in made]), []
    for k, name in enumerate(KINDS):
        own, truth = chance[kind == k], y[kind == k]
        order = np.argsort(-own, kind="stable")
        right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
        # equal chances are taken together
        ends = np.flatnonzero(np.append(own[order][1:] != own[order][:-1], True))
        enough = ends[right[ends] >= precision] if len(order) else ends
        if not len(enough) or not truth.sum():
            raise RuntimeError(f"no threshold gives {name} a precision of {precision}")
        threshold = max(0.5, float(own[order[enough[-1]]]))
        taken = own >= threshold
        out.append((name, threshold, float(truth[taken].mean()), float(truth[taken].sum() / truth.sum())))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each run of overlapping spans as the first one's kind in brackets."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _suspect(texts) -> np.ndarray:
    """Whether a text has anything that a base pattern or a generator starts from."""
    return np.asarray(pc.match_substring_regex(texts, SUSPECT).fill_null(False))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every text. The counts are of base spans."""
    scratch.small_batches(docs.sparkSession)
    fitted = model()

    def rows(batches):
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            some = _suspect(batch.column(1))
            counts, sums, spans, added = np.zeros((len(some), 4), np.int64), [nothing] * len(some), [""] * len(some), np.zeros(len(some), np.int64)
            for i in np.flatnonzero(some).tolist():
                value = batch.column(1)[i].as_py()
                base = base_spans(value)
                for _, k, _ in base:
                    counts[i, k] += 1
                found = fitted.spans(value, base)
                sums[i], spans[i], added[i] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(found), len(found) - len(base)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(counts[:, k]) for k in range(4)], pa.array(sums, pa.string()), pa.array(spans, pa.string()), pa.array(added)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(textkit.lean(rows), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact_documents(docs: DataFrame, text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """docs with every span redacted; the column `size`, if there, is the new text's length. Other columns and null texts stay as they are."""
    scratch.small_batches(docs.sparkSession)
    fitted, names = model(), docs.columns
    at, at_size = names.index(text), names.index(size) if size in names else None

    def rows(batches):
        for batch in batches:
            texts = batch.column(at)
            some = np.flatnonzero(_suspect(texts)).tolist()
            new = {i: redact(v, spans) for i in some if (spans := fitted.spans(v := texts[i].as_py()))}
            if new:
                values = texts.to_pylist()
                for i, v in new.items():
                    values[i] = v
                columns = list(batch.columns)
                columns[at] = pa.array(values, batch.schema.field(at).type)
                if at_size is not None:
                    sizes = columns[at_size].to_pylist()
                    for i, v in new.items():
                        sizes[i] = len(v)
                    columns[at_size] = pa.array(sizes, batch.schema.field(at_size).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(textkit.lean(rows), docs.schema)


def op5(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
