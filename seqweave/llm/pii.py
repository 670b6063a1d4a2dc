"""Surrogates for personal data.

Entities are found by patterns: e-mail and network addresses, telephone, account, bank and social security numbers,
secrets, and names after a title. A bare run of 13 to 19 digits is an account number if it has an issuer's first digit and
its check digit holds, a word before it says so, or it stands beside another one; other long numbers stay. Each entity is
replaced by a surrogate that a secret key draws from (kind, normal form, attempt): the same one gets the same surrogate
everywhere (coreference), in the form in which it stands (separators, letter case, script). A given name has the gender of
its titles in the document, whichever of its mentions has them; if these tell none, that of the corpus's other documents,
if they agree, and else the male form. Distinctness is checked over the whole corpus: of entities that draw the same
surrogate, or one that is itself an entity of the corpus, all but one draw again.
Only those that had to draw again, and names whose gender other documents tell, are looked up when texts are
rewritten; all others are drawn on the spot.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialize, small

#: Spark's setting that holds the secret key. Where it's unset each call draws a key, and surrogates agree within it only.
KEY_SETTING = "spark.seqweave.pii.key"
#: Most entities that drew again and travel with the task; more are joined to their documents.
EXCEPTIONS = 20_000
ROUNDS = 64

_MALE, _FEMALE = ("Mr", "Mister", "Herr", "Herrn", "Monsieur", "Señor"), ("Mrs", "Ms", "Miss", "Frau", "Fräulein", "Madame", "Mademoiselle", "Señora", "Señorita")
_OTHER = ("Dr", "Prof", "Professor")
_TITLES = "|".join(sorted(_MALE + _FEMALE + _OTHER, key=len, reverse=True))
_ENTITY = re.compile(
    r"(?P<email>(?<![\w.+%-])[\w.+%-]++@[\w-]++(?:\.[\w-]++)+)"
    r"|(?P<secret>(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z]))"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d))"
    r"|(?P<phone>(?<![\w+])\+?\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?!\d)|(?<![\w+.-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-]))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<account>(?<!\d)(?:\d{4}(?:[ -]\d{4}){3}|\d{13,19})(?!\d))"
    rf"|(?P<name>(?<!\w)(?P<title>{_TITLES})\.?[ ]+(?P<one>[^\W\d_][\w'’-]*)(?:[ ]+(?P<two>[^\W\d_][\w'’-]+))?)"
)
#: What a text has to hold, besides digits and @, before the patterns are tried: beginnings of titles and assigned names.
_HINTS = ("Mr", "Mis", "Ms", "Herr", "Monsieur", "Señor", "Frau", "Fräulein", "Mad", "Dr", "Prof")
assert all(any(t.startswith(h) for h in _HINTS) for t in _MALE + _FEMALE + _OTHER)
_ASSIGNED = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|key)\s*[=:]\s*[\"']?(?P<value>[\w/+.-]{12,})")

#: Words as names may be written, and their parts with the hyphens and apostrophes that follow.
_JOINTS = "-'’"
_WORD = re.compile(r"(?<!\w)[^\W\d_][\w'’-]*+")
_JOINED = re.compile(r"[^'’-]*+['’-]++|[^'’-]++")

#: What names a bare number as one of an account, ahead of it, or as one more of such numbers.
_ACCOUNT = re.compile(r"(?i)(?:account|acct|konto|compte|cuenta|card|karte|carte|tarjeta)\w{0,10}\W{0,3}(?:no|nr|num|number|nummer)?\W{0,3}$")
_ONE_MORE = re.compile(r"(?i)\W{1,3}(?:(?:or|and|und|et|ou|y|o)\W{1,3})?")

_ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
_SYLLABLES = {"latin": ("ba be da do ka ke la lo ma mi na no pa ra ri sa se ta to va".split(), "n r l s t m".split()), "cyrillic": ("ба бо да де ка ко ла ли ма ми на но па ра ро са се та то ва".split(), "н в р л м т".split()), "greek": ("βα δα δο κα κο λα λι μα μι να νο πα ρα ρο σα σε τα το φα θε".split(), "ς ν ς ρ ς ν".split())}


def script_of(word: str) -> str:
    for c in word:
        if "Ͱ" <= c <= "Ͽ":
            return "greek"
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
    return "latin"


class _Draw:
    """An endless keyed stream of numbers."""

    def __init__(self, key: str, *of: object):
        self.seed, self.n, self.left = "\x1f".join(map(str, of)).encode("utf-8", "surrogatepass"), 0, 0
        self.key, self.bits = hashlib.sha256(key.encode()).digest(), 0

    def below(self, n: int) -> int:
        if self.left < 32:
            block = hashlib.blake2b(self.seed + b"\x1e%d" % self.n, key=self.key, digest_size=64).digest()
            self.n, self.bits, self.left = self.n + 1, int.from_bytes(block, "big"), 512
        self.left -= 32
        out, self.bits = (self.bits & 0xFFFFFFFF) % n, self.bits >> 32
        return out


def _luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def _like(text: str, draw: _Draw) -> str:
    """Characters of the same class (digit, letter of the script and case) for each; others stay."""
    out = []
    for c in text:
        if c.isdigit():
            out.append(str(draw.below(10)))
        elif c.isalpha():
            alphabet = _ALPHABETS[script_of(c)]
            new = alphabet[draw.below(len(alphabet))]
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def secret_key(spark: SparkSession) -> str:
    """The configured key, or a fresh one."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def draw_surrogate(kind: str, norm: str, attempt: int, key: str) -> str:
    """The normal form of an entity's surrogate."""
    draw = _Draw(key, kind, norm, attempt)
    if kind == "email":
        local, _, domain = norm.partition("@")
        top = domain.rpartition(".")[2]
        new = _like(local, draw) + ("" if attempt < 3 else str(draw.below(10 ** min(attempt, 9))))
        where = _Draw(key, "domain", domain, 0)
        return f"{new}@{''.join(_ALPHABETS['latin'][where.below(26)] for _ in range(8))}.example" + (f".{top}" if top in {"com", "net", "org"} else "")
    if kind == "secret":
        return "".join("0123456789abcdef"[draw.below(16)] if re.fullmatch("[0-9a-f]+", norm) else _like(c, draw) for c in norm)
    if kind == "ip":
        octets = [1 + draw.below(223), draw.below(256), draw.below(256), 1 + draw.below(254)]
        return ".".join(map(str, octets)) if octets[0] not in {10, 127, 172, 192} else ".".join(map(str, [11, *octets[1:]]))
    if kind == "iban":
        return norm[:2] + _like(norm[2:], draw)
    if kind == "phone":
        country, _, rest = norm.partition("|")
        return f"{country}|{_like(rest, draw)}"
    if kind == "ssn":
        return _like(norm, draw)
    if kind == "account":
        new = str(1 + draw.below(9)) + _like(norm[1:], draw)
        wanted = _luhn(norm)
        return next(x for x in (new[:-1] + str((int(new[-1]) + d) % 10) for d in range(10)) if _luhn(x) == wanted)
    # given:m, given:f, surname
    syllables, ends = _SYLLABLES[script_of(norm)]
    word = "".join(syllables[draw.below(len(syllables))] for _ in range(2 + draw.below(2) + attempt // 4))
    last = {"latin": "a", "cyrillic": "а", "greek": "α"}[script_of(norm)]
    if kind == "given:f":
        return word[:-1] + last
    return word + ends[draw.below(len(ends))]


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _fill(form: str, digits: str) -> str:
    """``form`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def _cased(form: str, new: str) -> str:
    return new.upper() if len(form) > 1 and form.isupper() else new[:1].upper() + new[1:] if form[:1].isupper() else new


class _Taken:
    """Spans without overlaps, in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(spans)
        self.ends = [b for _, b in self.spans]

    def meets(self, a: int, b: int) -> bool:
        i = bisect_left(self.ends, a + 1)
        return i < len(self.spans) and self.spans[i][0] < b


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(begin, end, kind, normal form) of all entities, in order, without overlaps. Kinds of given names are given:m,
    given:f and, where no title of the text tells, given:x."""
    out: list[tuple[int, int, str, str]] = []
    names: dict[str, str] = {}
    votes: Counter[str] = Counter()
    for m in _ENTITY.finditer(text):
        kind, whole = m.lastgroup, m.group()
        if m.group("name"):
            parts = [g for g in ("one", "two") if m.group(g) and m.group(g)[0].isupper()]
            if not parts or parts[0] != "one":
                continue
            for g, what in zip(parts, (["surname"] if len(parts) == 1 else ["given", "surname"]), strict=True):
                norm = m.group(g).lower()
                out.append((m.start(g), m.end(g), what, norm))
                names.setdefault(m.group(g), what)
                if what == "given":
                    votes[norm] += (m.group("title") in _MALE) - (m.group("title") in _FEMALE)
            continue
        kind = next(k for k in ("email", "secret", "iban", "ip", "phone", "ssn", "account") if m.group(k))
        if kind == "email":
            norm = whole.lower()
        elif kind == "ip":
            octets = [int(x) for x in whole.split(".")]
            if max(octets) > 255:
                continue
            norm = ".".join(map(str, octets))
        elif kind == "phone":
            country = re.match(r"\+?(\d{1,3})(?=[ .(-])", whole) if whole[0] == "+" or re.match(r"\d{1,3}[ .-]?\(", whole) else None
            norm = f"{country.group(1) if country else ''}|{_digits(whole[country.end() if country else 0:])}"
        elif kind == "secret":
            norm = whole.lower()
        elif kind == "iban":
            norm = whole.replace(" ", "")
            if not 15 <= len(norm) <= 34:
                continue
        else:
            norm = _digits(whole)
            # A run of digits is an account's if its check digit holds, or what stands before it says so.
            if kind == "account" and whole.isdigit() and not (norm[0] in "23456" and _luhn(norm)):
                said = _ACCOUNT.search(text, max(0, m.start() - 40), m.start())
                if not said and not (out and out[-1][2] == "account" and _ONE_MORE.fullmatch(text, out[-1][1], m.start())):
                    continue
        out.append((m.start(), m.end(), kind, norm))
    taken = _Taken([(a, b) for a, b, _, _ in out])
    for m in _ASSIGNED.finditer(text):
        a, b = m.span("value")
        if any(c.isdigit() for c in m.group("value")) and not taken.meets(a, b):
            out.append((a, b, "secret", m.group("value")))
    # A name goes on without its title, also as part of a word with hyphens or apostrophes.
    if names:
        taken = _Taken([(a, b) for a, b, _, _ in out])
        most = max(len(_JOINED.findall(n)) for n in names)
        for m in _WORD.finditer(text):
            cuts = [m.start(), *(x.end() for x in _JOINED.finditer(text, m.start(), m.end()))] if most > 1 or not m.group().isalnum() else [m.start(), m.end()]
            i = 0
            while i < len(cuts) - 1:
                for j in range(min(len(cuts) - 1, i + most), i, -1):
                    a, b = cuts[i], cuts[j]
                    while b > a and text[b - 1] in _JOINTS and text[a:b] not in names:
                        b -= 1
                    if (name := text[a:b]) in names and not taken.meets(a, b):
                        out.append((a, b, names[name], name.lower()))
                        i = j
                        break
                else:
                    i += 1
    gender = lambda n: "given:m" if votes[n] > 0 else "given:f" if votes[n] < 0 else "given:x"
    return sorted((a, b, gender(n) if k == "given" else k, n) for a, b, k, n in out)


def rewrite(text: str, again: dict[tuple[str, str], int], women: set[str] | frozenset[str], key: str) -> tuple[str, int]:
    """The text with surrogates, and the number of places. ``again``: attempts of the entities that drew again; ``women``:
    given names that are female where no title of the text tells."""
    out, at, found = [], 0, find(text)
    for a, b, kind, norm in found:
        if kind == "given:x":
            kind = "given:f" if norm in women else "given:m"
        form, new = text[a:b], draw_surrogate(kind, norm, again.get((kind, norm), 0), key)
        if kind == "phone":
            country, digits = norm.partition("|")[0], new.partition("|")[2]
            new = _fill(form, country + digits)
        elif kind in ("ssn", "account"):
            new = _fill(form, new)
        elif kind == "iban":
            it = iter(new)
            new = "".join(c if c == " " else next(it) for c in form)
        elif kind == "secret" or kind == "email":
            new = new.upper() if form.isupper() else new
        elif kind != "ip":
            new = _cased(form, new)
        out += (text[at:a], new)
        at = b
    return "".join([*out, text[at:]]), len(found)


def _hints(text: Column) -> Column:
    """Whether the patterns are worth trying: cheap searches in the JVM, true for all texts that hold an entity."""
    hint = text.rlike("[0-9@]")
    for h in _HINTS:
        hint |= text.contains(h)
    return hint


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """The distinct (kind, norm) of all texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame(sorted({x[2:] for t in frame["text"] for x in find(t)}), columns=["kind", "norm"], dtype=object)

    return docs.select(F.col(text).alias("text")).filter(_hints(F.col("text"))).mapInPandas(run, "kind string, norm string").distinct()


def female_names(found: DataFrame) -> DataFrame:
    """(norm) of the given names that some documents give no gender, and all that give one the female."""
    kinds = found.filter("kind like 'given:%'").groupBy("norm").agg(F.collect_set("kind").alias("kinds"))
    return kinds.filter(F.array_contains("kinds", "given:x") & F.array_contains("kinds", "given:f") & ~F.array_contains("kinds", "given:m")).select("norm")


def drawn_again(found: DataFrame, key: str) -> DataFrame:
    """(kind, norm, attempt) of the entities whose first surrogates weren't distinct or were entities themselves."""
    spark = found.sparkSession

    @F.pandas_udf("string")
    def candidate(kinds: pd.Series, norms: pd.Series, attempts: pd.Series) -> pd.Series:
        return pd.Series([draw_surrogate(k, n, a, key) for k, n, a in zip(kinds, norms, attempts, strict=True)], dtype=object)

    own = found.select("kind", F.col("norm").alias("cand"))
    pending = materialize(found.select("kind", "norm", F.lit(0).alias("attempt")).withColumn("cand", candidate("kind", "norm", "attempt")), "drawn")
    settled, again = None, None
    for _ in range(ROUNDS):
        free = pending.join(own, ["kind", "cand"], "left_anti")
        if settled is not None:
            free = free.join(settled, ["kind", "cand"], "left_anti")
        first = materialize(free.groupBy("kind", "cand").agg(F.min("norm").alias("norm"), F.min_by("attempt", "norm").alias("attempt")), "settled")
        lost = pending.join(first, ["kind", "norm"], "left_anti").withColumn("attempt", F.col("attempt") + 1)
        new = first.filter("attempt > 0").select("kind", "norm", "attempt")
        again = new if again is None else again.unionByName(new)
        settled = first.select("kind", "cand") if settled is None else settled.unionByName(first.select("kind", "cand"))
        last, pending = pending, materialize(lost.select("kind", "norm", "attempt").withColumn("cand", candidate("kind", "norm", "attempt")), "drawn")
        forget(last)
        if pending.isEmpty():
            return materialize(again, "again")
    raise RuntimeError(f"surrogates of some entities are still not distinct after {ROUNDS} draws")


def replace_pii(docs: DataFrame, text: str = "text", key: str | None = None, exceptions: int = EXCEPTIONS) -> DataFrame:
    """``docs`` with surrogates in ``text`` and ``n_entities``, the number of places replaced (0 for null texts).

    ``key`` is the secret (by default that of the setting ``KEY_SETTING``). Null texts stay null, empty ones empty; texts
    without entities stay as they are; repeated rows get the same surrogates; an empty table gives no rows. Texts of any
    length are searched in one pass, also without blanks. A column named n_entities is replaced. ``docs`` is read twice
    (three times if more than ``exceptions`` entities have to be looked up).
    """
    key = key or secret_key(docs.sparkSession)
    docs = docs.select(*(c for c in docs.columns if c != "n_entities"))
    found = materialize(entities(docs, text), "entities")
    women = materialize(female_names(found), "women")
    gendered = found.join(small(women.withColumn("_f", F.lit(True))), "norm", "left").select(F.when(F.col("kind") != "given:x", F.col("kind")).when(F.col("_f"), "given:f").otherwise("given:m").alias("kind"), "norm")
    again = drawn_again(materialize(gendered.distinct(), "gendered"), key)
    # What is looked up: attempts by kind and name; a female name as kind given:x.
    listed = again.unionByName(women.select(F.lit("given:x").alias("kind"), "norm", F.lit(0).alias("attempt")))
    few = listed.limit(exceptions + 1).collect()
    if len(few) <= exceptions:
        known, ladies = {(r["kind"], r["norm"]): r["attempt"] for r in few if r["kind"] != "given:x"}, {r["norm"] for r in few if r["kind"] == "given:x"}

        @F.pandas_udf("text string, n long")
        def of(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([rewrite(t, known, ladies, key) if t is not None else (None, 0) for t in texts], columns=["text", "n"])

        done = docs.withColumn("_new", of(F.when(_hints(F.col(text)), F.col(text))))
    else:
        # Each text's own exceptions travel with it, keyed by the text.
        digest = F.sha2(F.col(text), 256)

        @F.pandas_udf("array<struct<kind: string, norm: string>>")
        def mentions(texts: pd.Series) -> pd.Series:
            of_text = lambda t: {x for _, _, k, n in find(t) for x in ([(k, n)] if k != "given:x" else [(k, n), ("given:m", n), ("given:f", n)])}
            return pd.Series([[{"kind": k, "norm": n} for k, n in sorted(of_text(t))] if t is not None else [] for t in texts], dtype=object)

        own = docs.select(digest.alias("_digest"), F.col(text).alias("_t")).filter(_hints(F.col("_t"))).select("_digest", F.explode(mentions("_t")).alias("m")).select("_digest", "m.*").distinct()
        own = own.join(listed, ["kind", "norm"]).groupBy("_digest").agg(F.collect_list(F.struct("kind", "norm", "attempt")).alias("_again"))

        @F.pandas_udf("text string, n long")
        def of(texts: pd.Series, drawn: pd.Series) -> pd.DataFrame:
            out = []
            for t, d in zip(texts, drawn, strict=True):
                mine = list(d) if d is not None else []
                out.append((None, 0) if t is None else rewrite(t, {(r["kind"], r["norm"]): r["attempt"] for r in mine}, {r["norm"] for r in mine if r["kind"] == "given:x"}, key))
            return pd.DataFrame(out, columns=["text", "n"])

        done = docs.withColumn("_digest", digest).join(own, "_digest", "left").withColumn("_new", of(F.when(_hints(F.col(text)), F.col(text)), F.col("_again")))
    return done.withColumn(text, F.coalesce(F.col("_new.text"), F.col(text))).withColumn("n_entities", F.coalesce(F.col("_new.n"), F.lit(0)).cast("long")).select(*docs.columns, "n_entities")
