"""Format-preserving pseudonyms for personal data by keyed Feistel permutations.

A value that passes its kind's validation is read as a number below the count of the format's values, permuted there by a
Feistel network under a key, and written back in the same shape: separators stay, check digits are made anew. It is a
permutation, so equal values stay equal across documents and different ones stay different, and with the key it can be undone.

There is no key in this file. A session has the one in its setting `spark.isofold.pseudonyms.secret`, or else one drawn at random that
nothing keeps: values are then linked within that session alone.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import ipaddress
import math
import re
import secrets
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, slices, text_buffer

ROUNDS = 10
SETTING = "spark.isofold.pseudonyms.secret"
_DRAWN: list[bytes] = []


def session_key(spark: SparkSession | None = None) -> bytes:
    """The key in the session's setting; where none is set, one drawn at random for this process."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None and (found := spark.conf.get(SETTING, None)):
        return found.encode()
    if not _DRAWN:
        _DRAWN.append(secrets.token_bytes(32))
    return _DRAWN[0]


class Feistel:
    """A keyed permutation of 0 to n - 1 for any n."""

    def __init__(self, key: bytes, tweak: str, n: int, rounds: int = ROUNDS):
        self.key, self.tweak, self.n, self.rounds = hashlib.blake2b(key, digest_size=32).digest(), tweak.encode(), n, rounds
        self.side = math.isqrt(n - 1) + 1 if n > 1 else 1

    def _f(self, r: int, x: int) -> int:
        raw = hashlib.shake_256(self.key + b"%d|%d|%d|" % (r, self.n, x) + self.tweak).digest(self.side.bit_length() // 8 + 9)
        return int.from_bytes(raw, "big") % self.side

    def _once(self, x: int, back: bool) -> int:
        left, right = divmod(x, self.side)
        for r in reversed(range(self.rounds)) if back else range(self.rounds):
            if back:
                left, right = (right - self._f(r, left)) % self.side, left
            else:
                left, right = right, (left + self._f(r, right)) % self.side
        return left * self.side + right

    def __call__(self, x: int, back: bool = False) -> int:
        """The image of x (back: what x is the image of); walks on while it is outside the domain."""
        if self.n <= 1:
            return x
        x = self._once(x, back)
        while x >= self.n:
            x = self._once(x, back)
        return x


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _refilled(shape: str, digits: str) -> str:
    """shape with its digits replaced in turn."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return str(-total % 10)


#: Spaces that part groups of a number.
_SPACE = " \u00a0\u2009\u202f"


def _card(s: str, permute) -> str | None:
    """One line end may stand in a number. With it or with dots the first digit is that of a bank card: such groups of four are often years or amounts."""
    d = _digits(s)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    if s.count("\n") > 1 or ("\n" in s or "." in s) and d[0] not in "3456":
        return None
    # the first digit, the issuer's industry, stays
    n = len(d) - 2
    body = d[0] + str(permute("card", int(d[1:-1]), 10**n)).zfill(n)
    return _refilled(s, body + luhn_digit(body))


#: Digits of a whole national number, by country code.
NATIONAL = {
    "1": (10,), "7": (10,), "20": (9, 10), "27": (9,), "30": (10,), "31": (9,), "32": (8, 9), "33": (9,), "34": (9,), "39": (9, 10, 11), "40": (9,), "41": (9,),
    "44": (9, 10), "45": (8,), "46": (7, 8, 9), "47": (8,), "48": (9,), "52": (10,), "55": (10, 11), "61": (9,), "64": (8, 9, 10), "65": (8,), "81": (9, 10), "82": (8, 9, 10),
    "86": (10, 11), "90": (10,), "91": (10,), "351": (9,), "353": (7, 8, 9), "358": (6, 7, 8, 9, 10), "420": (9,), "852": (8,),
}


def _phone(s: str, permute) -> str | None:
    """A zero in brackets, dialled within the country only, isn't part of the number and stays."""
    s = s.replace("(0)", "(\0)")
    d = _digits(s)
    keep = 0
    if s.startswith("+"):
        code = next((d[:n] for n in (1, 2, 3) if d[:n] in NATIONAL), None)
        if code is None and not 8 <= len(d) <= 15 or code is not None and len(d) - len(code) not in NATIONAL[code]:
            return None
        keep = len(code or "0")
    elif len(d) != 10 and not (len(d) == 11 and d[0] == "1"):
        return None
    keep = max(keep, len(d) - 10)
    n = len(d) - keep
    # a code that is known stays known, and one that isn't stays so, and a number that may be written with spaces alone stays one: walk on until it reads as it did
    shape, x = d[:keep], int(d[keep:])
    while True:
        x = permute("phone", x, 10**n)
        new = shape + str(x).zfill(n)
        if (new[keep] > "1") == (d[keep] > "1") and (not s.startswith("+") or next((new[:k] for k in (1, 2, 3) if new[:k] in NATIONAL), None) == code):
            return _refilled(s, new).replace("(\0)", "(0)")


def _ip(s: str, permute) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = permute("ip", int.from_bytes(bytes(map(int, parts)), "big"), 2**32)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _long_form(address: str) -> bool:
    """Three groups and a digit at least: what has fewer is no one's own, or isn't an address."""
    return "." not in address and sum(map(bool, address.split(":"))) >= 3 and any(c in "0123456789" for c in address)


def _ipv6(s: str, permute) -> str | None:
    """An address is its number, however it is written; its pseudonym is in the shortest form."""
    try:
        x = int(ipaddress.IPv6Address(s))
    except ValueError:
        return None
    if not _long_form(s) or not _long_form(str(ipaddress.IPv6Address(x))):
        return None
    while True:
        x = permute("ipv6", x, 2**128)
        if _long_form(new := str(ipaddress.IPv6Address(x))):
            return new


def _ssn(s: str, permute) -> str | None:
    a, b, c = int(s[:3]), int(s[4:6]), int(s[7:])
    if a in (0, 666) or a >= 900 or not b or not c:
        return None
    x = permute("ssn", ((a - 1 - (a > 666)) * 99 + b - 1) * 9999 + c - 1, 898 * 99 * 9999)
    x, c = divmod(x, 9999)
    a, b = divmod(x, 99)
    a = a + 1 + (a + 1 >= 666)
    return f"{a:03d}{s[3]}{b + 1:02d}{s[6]}{c + 1:04d}"


#: The length of a country's account numbers.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "TR": 26,
}


def _iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def _iban(s: str, permute) -> str | None:
    """Capital and small forms are one value; small ones are of countries with a known length."""
    flat = re.sub(f"[{_SPACE}]", "", s).upper()
    country, body = flat[:2], flat[4:]
    if country not in IBAN_LENGTHS and s[:2] != country:
        return None
    if len(flat) != IBAN_LENGTHS.get(country, len(flat)) or not 15 <= len(flat) <= 34 or _iban_check(country, body) != flat[2:4]:
        return None
    body = _by_class("iban", body, permute)
    it = iter(country + _iban_check(country, body) + body)
    return "".join(c if c in _SPACE else next(it).lower() if c != c.upper() else next(it) for c in s)


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


@functools.lru_cache(1024)
def _letters(block: int) -> str:
    """The small letters, or letters without case, among 128 code points; those without a capital that leads back to them are left out."""
    chars = map(chr, range(block * 128, block * 128 + 128))
    return "".join(c for c in chars if c.isalpha() and c.lower() == c and len(c.upper()) == 1 and c.upper().lower() == c)


def _class(c: str) -> str:
    if ord(c) > 127:
        return found if c in (found := _letters(ord(c) // 128)) else ""
    return next((x for x in _CLASSES if c in x), "")


def _by_class(tweak: str, s: str, permute) -> str:
    """Digits to digits, small letters to small, capitals to capitals, others of 128 neighbours to one another, all at once; what isn't a letter stays."""
    sets = [_class(x) for x in s]
    n, x = 1, 0
    for c, alphabet in zip(s, sets):
        if alphabet:
            n, x = n * len(alphabet), x * len(alphabet) + alphabet.index(c)
    x = permute(tweak, x, n)
    out = []
    for c, alphabet in zip(reversed(s), reversed(sets)):
        if alphabet:
            x, i = divmod(x, len(alphabet))
            c = alphabet[i]
        out.append(c)
    return "".join(reversed(out))


#: Mail domains of the public, which say nothing of their users. They stay; others are pseudonymised up to their last part.
PUBLIC_DOMAINS = frozenset(
    """aol.com example.com example.net example.org free.fr gmail.com gmx.at gmx.ch gmx.de gmx.net googlemail.com hotmail.com hotmail.co.uk hotmail.de hotmail.es hotmail.fr icloud.com
    laposte.net libero.it live.com mail.com mail.ru me.com msn.com orange.fr outlook.com outlook.de outlook.es outlook.fr proton.me protonmail.com qq.com t-online.de terra.es wanadoo.fr
    web.de yahoo.co.jp yahoo.co.uk yahoo.com yahoo.de yahoo.es yahoo.fr yandex.ru zoho.com 126.com 163.com""".split()
)


def _public(domain: str) -> bool:
    parts = domain.split(".")
    return any(".".join(parts[i:]) in PUBLIC_DOMAINS for i in range(len(parts)))


def _small(c: str) -> str:
    """The small form of a letter whose capital leads back to it."""
    return low if len(low := c.lower()) == 1 and low.upper() == c else c


def _email(s: str, permute) -> str | None:
    """Capital and small forms of an address are one value: the small one is permuted, and capitals stand where they stood. Parts of any length, by 64 characters."""
    local, _, domain = "".join(map(_small, s)).rpartition("@")
    new = "".join(_by_class("email", local[i : i + 64], permute) for i in range(0, len(local), 64))
    if not _public(domain):
        name, _, last = domain.rpartition(".")
        while True:
            name = _by_class("domain", name, permute)
            if not _public(f"{name}.{last}"):
                break
        domain = f"{name}.{last}"
    return "".join(c.upper() if was != _small(was) else c for c, was in zip(f"{new}@{domain}", s))


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _date(s: str, permute) -> str | None:
    parts = re.split(r"[-/.]", s)
    order = "ymd" if len(parts[0]) == 4 else "dmy"
    named = dict(zip(order, parts))
    if order == "dmy" and "/" in s and int(named["m"]) > 12:
        order = "mdy"
        named = dict(zip(order, parts))
    try:
        day = datetime.date(int(named["y"]), int(named["m"]), int(named["d"])).toordinal()
    except ValueError:
        return None
    if not _FIRST <= day <= _LAST:
        return None
    day -= _FIRST
    while True:
        day = permute("date", day, _LAST - _FIRST + 1)
        new = datetime.date.fromordinal(day + _FIRST)
        # a month-first date is known by its day: walk on to one that is read so again
        if order != "mdy" or new.day > 12:
            break
    values = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
    seps = re.findall(r"[-/.]", s)
    return values[order[0]] + seps[0] + values[order[1]] + seps[1] + values[order[2]]


#: How access tokens of known services begin, and what follows.
TOKENS = (
    ("AKIA", "[0-9A-Z]{16}"),
    ("ASIA", "[0-9A-Z]{16}"),
    ("ghp_", "[0-9A-Za-z]{36,255}"),
    ("gho_", "[0-9A-Za-z]{36,255}"),
    ("ghu_", "[0-9A-Za-z]{36,255}"),
    ("ghs_", "[0-9A-Za-z]{36,255}"),
    ("ghr_", "[0-9A-Za-z]{36,255}"),
    ("github_pat_", "[0-9A-Za-z_]{22,255}"),
    ("glpat-", "[0-9A-Za-z_-]{20,255}"),
    ("xoxb-", "[0-9A-Za-z-]{10,255}"),
    ("xoxp-", "[0-9A-Za-z-]{10,255}"),
    ("AIza", "[0-9A-Za-z_-]{35}"),
    ("sk-", "[0-9A-Za-z_-]{20,255}"),
    ("sk_live_", "[0-9A-Za-z]{16,255}"),
)


def _secret(s: str, permute) -> str | None:
    head = next((head for head, _ in TOKENS if s.startswith(head)), None)
    if head is not None:
        # words with a hyphen may begin as tokens do, but hold no digits
        return head + _by_class("token", s[len(head) :], permute) if head.isupper() or any(c in "0123456789" for c in s) else None
    if len(set(s)) < 6:
        return None
    alphabet = "0123456789abcdef" if s == s.lower() else "0123456789ABCDEF"
    x = permute("secret", int(s, 16), 16 ** len(s))
    return f"{x:0{len(s)}x}".translate(str.maketrans("abcdef", alphabet[10:]))


#: What the local part of an address is made of; it begins where none of these stands before.
_LOCAL = r"[\w.%+'\u0300-\u036f-]"
_TOKEN = "|".join(head + body for head, body in TOKENS)
#: What parts groups: of a phone number, and of a card's.
_PART, _SPLIT = f"[{_SPACE}.-]", f"(?:[{_SPACE}.-]|[{_SPACE}.-]?\\r?\\n)"
#: (kind, pattern, how it is validated and replaced), in order of precedence at one place.
KINDS: list[tuple[str, str, Callable]] = [
    ("email", rf"(?<!{_LOCAL}){_LOCAL}+@(?:[\w-]{{1,63}}\.){{1,8}}(?:[^\W\d_]{{2,24}}|xn--[0-9a-z-]{{2,59}})(?![^\W_])", _email),
    ("secret", rf"(?<![0-9A-Za-z])(?:[0-9a-f]{{32,128}}|[0-9A-F]{{32,128}}|{_TOKEN})(?![0-9A-Za-z])", _secret),
    ("iban", rf"(?<![0-9A-Za-z])(?:[A-Z]{{2}}[0-9]{{2}}(?:[{_SPACE}]?[A-Z0-9]{{4}}){{2,7}}(?:[{_SPACE}]?[A-Z0-9]{{1,3}})?|[a-z]{{2}}[0-9]{{2}}(?:[{_SPACE}]?[a-z0-9]{{4}}){{2,7}}(?:[{_SPACE}]?[a-z0-9]{{1,3}})?)(?![0-9A-Za-z])", _iban),
    ("ipv6", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:]|\.[0-9])", _ipv6),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", _ip),
    ("date", r"(?<![0-9./-])(?:[0-9]{4}(?P<sep1>[-/.])[0-9]{2}(?P=sep1)[0-9]{2}|[0-9]{2}(?P<sep2>[-/.])[0-9]{2}(?P=sep2)[0-9]{4})(?![0-9]|[./-][0-9])", _date),
    ("ssn", rf"(?<![0-9-])[0-9]{{3}}(?P<sep3>[-{_SPACE}])[0-9]{{2}}(?P=sep3)[0-9]{{4}}(?![0-9]|-[0-9])", _ssn),
    (
        "phone",
        rf"(?<![0-9A-Za-z+])(?:\+[0-9]{{1,3}}{_PART}?)?(?:\([0-9]{{3}}\)[{_SPACE}]?|[0-9]{{3}}[.-])[0-9]{{3}}{_PART}[0-9]{{4}}(?![0-9])"
        rf"|(?<![0-9A-Za-z+])\+[0-9]{{1,3}}(?:{_PART}?\(0\))?(?:{_PART}?[0-9]{{2,4}}){{2,5}}(?![0-9])"
        rf"|(?<![0-9A-Za-z+])(?<![0-9][{_SPACE}])(?:1[{_SPACE}])?[2-9][0-9]{{2}}[{_SPACE}][0-9]{{3}}[{_SPACE}][0-9]{{4}}(?![0-9A-Za-z]|[{_SPACE}][0-9])",
        _phone,
    ),
    ("card", rf"(?<![0-9])(?:[0-9]{{13,19}}|[0-9]{{4}}(?:{_SPLIT}[0-9]{{4}}){{2,3}}(?:{_SPLIT}[0-9]{{1,4}})?|[0-9]{{4}}{_SPLIT}[0-9]{{6}}{_SPLIT}[0-9]{{5}})(?![0-9])", _card),
]
_KINDS = [(k, re.compile(p), f) for k, p, f in KINDS]
#: Where a value of any kind may begin.
_BEGIN = re.compile(rf"(?<![0-9A-Za-z])[0-9A-Za-z+(]|(?<=[A-Za-z])[0-9]|(?<![0-9A-Za-z:.])::|(?<!{_LOCAL}){_LOCAL}")
#: Where a value of groups may end earlier than its pattern took it.
_GROUP = re.compile(rf"[{_SPACE}.\r\n-]+(?=[0-9A-Za-z])")
_GROUPED = {"card", "phone", "iban"}
#: A text without any of these holds no value.
_HINT = "[0-9@]|" + "|".join(head for head, _ in TOKENS)
_RUN = re.compile(rf"(?<!\S)\S*(?:{_HINT})\S*(?:(?:[{_SPACE}]|\r?\n)(?:\S*(?:{_HINT})\S*|[A-Za-z]{{4}}(?!\S)))*")


class Pseudonymizer:
    """Replaces validated values in texts. The same key gives the same pseudonyms anywhere; without one, the session's."""

    def __init__(self, key: bytes | None = None, back: bool = False):
        self.key, self.back = session_key() if key is None else key, back
        self.networks: dict[tuple[str, int], Feistel] = {}

    def permute(self, tweak: str, x: int, n: int) -> int:
        network = self.networks.get((tweak, n))
        if network is None:
            network = Feistel(self.key, tweak, n)
            if len(self.networks) < 4096:
                self.networks[tweak, n] = network
        return network(x, self.back)

    def _at(self, run: str, at: int) -> tuple[str, int, str] | None:
        """(kind, end, pseudonym) of the value that begins at `at`: of the kinds in order, the first with a valid form, the longest."""
        for kind, pattern, become in _KINDS:
            m = pattern.match(run, at)
            if m is None:
                continue
            ends = [m.end()]
            if kind in _GROUPED:
                ends += [at + g.start() for g in reversed(list(_GROUP.finditer(m[0])))]
            for end in ends:
                if (kind != "phone" or end == m.end() or run[at] == "+") and (new := become(run[at:end], self.permute)) is not None:
                    return kind, end, new
        return None

    def __call__(self, text: str) -> tuple[str, dict[str, int]]:
        counts: dict[str, int] = {}

        def values(m: re.Match) -> str:
            run, out, done, at = m[0], [], 0, 0
            while (begin := _BEGIN.search(run, at)) is not None:
                at = begin.start()
                found = self._at(run, at)
                if found is None:
                    at += 1
                    continue
                kind, end, new = found
                counts[kind] = counts.get(kind, 0) + 1
                out += [run[done:at], new]
                done = at = end
            return "".join([*out, run[done:]]) if out else run

        # words with a hint, and such words in a row, are all that can hold a value
        return _RUN.sub(values, text), counts


def pseudonymized(docs: DataFrame, key: bytes | None = None, back: bool = False, counts: str | None = "pii_counts") -> DataFrame:
    """docs with its text pseudonymised, and in a column of the name `counts`, if any, a map from kind to the number of values replaced.

    Emails (letters of any script), hexadecimal secrets and access tokens of known services, IBANs, IPv4 and IPv6 addresses, dates, social security, phone and card numbers that are valid in their kind. Of
    what a place may hold the first kind with a valid form wins, by its longest form; what fails validation stays as it is, and so do
    social security numbers without separators, which any nine digits look like, and phone numbers with spaces alone (555 123 4567) that begin with 0 or 1
    or stand among other numbers. Letters may touch a card's digits. Mail domains of the public stay. Null texts stay null; other
    columns, ids and repeated rows are as they were, but a column of docs of the name `counts` is replaced. One pass, no shuffle.
    """
    key = session_key(docs.sparkSession) if key is None else key
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != counts))
    place = docs.columns.index("text")
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names).withColumn(names[place], F.col(names[place]).cast("string"))
    last = [] if counts is None else [T.StructField("counts", T.MapType(T.StringType(), T.LongType()))]

    def run(batches):
        worker = Pseudonymizer(key, back)
        for whole in batches:
            _, bytes_ = text_buffer(whole.column(place))
            for lo, hi in slices(bytes_, 4_000_000):
                batch = whole.slice(lo, hi - lo)
                column = batch.column(place)
                has = pc.fill_null(pc.match_substring_regex(column, _HINT), False).to_numpy(zero_copy_only=False)
                texts = column.to_pylist() if has.any() else None
                found: list = [{}] * batch.num_rows
                if texts:
                    for i in np.flatnonzero(has).tolist():
                        texts[i], found[i] = worker(texts[i])
                columns = [pa.array(texts, pa.string()) if i == place and texts else c for i, c in enumerate(batch.columns)]
                tail = [pa.array([list(c.items()) for c in found], pa.map_(pa.string(), pa.int64()))] if last else []
                yield pa.RecordBatch.from_arrays([*columns, *tail], [*names, *(f.name for f in last)])
            give_back()

    return own.mapInArrow(run, T.StructType([*own.schema.fields, *last])).toDF(*docs.columns, *([counts] if last else []))


def op4_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the whole text with pseudonyms, how many values were replaced, and how many of each kind."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pseudonymized(docs, session_key(spark))
    total = F.aggregate(F.map_values("pii_counts"), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("doc_id", "text", total.alias("n_values"), *(F.coalesce(F.try_element_at("pii_counts", F.lit(k)), F.lit(0)).alias(f"n_{k}") for k, _, _ in KINDS))
