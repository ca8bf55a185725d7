"""PII: detected entities get keyed, type-consistent surrogates.

Entities: e-mail addresses, telephone numbers, IPv4 addresses, payment cards
(Luhn), IBANs (mod 97), US social security numbers, access keys, secrets after
`password=` and the like, and names behind a title, names of two or three words beside a cue (`John Smith wrote to
Anna Brown`) and given names in salutations, with their other mentions in
the same text. A name that no title or cue tells, and that no other mention does, is not found. A secret in quotes goes to the closing one, any other to
white space, a quote, `<`, `>`, or a delimiter that white space, the text's end or another `name=`
follows; its full stop or bracket at the end stays. A surrogate is drawn
from a keyed hash of the entity's type and normal form, so an entity gets the same surrogate
wherever and however it is written (coreference), in the mention's own format:
length, punctuation, case, check digits, country code, and for names gender and script.
A telephone number is the same entity with and without its country code. IPv6 addresses, postal
addresses and dates of birth are no entities here and stay as they are.

Collision checks: one pass gathers the distinct entities of the corpus. Where a
surrogate equals that of another entity, of whatever type, or is itself an entity of the corpus,
it is drawn anew, in rounds until all are distinct. After NARROW draws in the
mention's own length and range, each further draw comes from a larger space (more
characters or digits, a wider address range), so a free surrogate always exists. Only these few entities
carry a number of attempts; each document gets those that it holds by a join on
its id, which the planner broadcasts if they are small. Texts don't leave their tasks
unless they aren't.

Defined results: an empty table stays empty; a null text stays null; an empty one stays empty; rows that
repeat a doc_id are treated alike; overlapping finds go to the earlier, then
the longer one; a secret without a letter or digit (a rule, a blank to fill in) is none; other columns are handed on, but that one named `entities` is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded, discard, materialize, packed, unpacked

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: A quoted secret, or an unquoted one.
SECRET = r"""(?:"([^"\n]++)"|'([^'\n]++)'|["'`]?((?:[^\s"'`<>,;|&]++|'(?=\w)|[,;|&](?!\s|\Z|["'`<>]|[a-z_][\w.-]{0,63}\s?[=:]))++))"""
#: (type, what a text must hold, pattern; the group that matched, if it has groups, is the entity)
PATTERNS = (
    ("email", "@", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])")),
    ("secret", "=:", re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|token|secret|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}" + SECRET)),
    ("access_key", "A", re.compile(r"(?<![A-Za-z0-9])A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9])")),
    ("iban", "0123456789", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ip", ".", re.compile(rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])")),
    ("card", "0123456789", re.compile(r"(?<![0-9-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]|-[0-9])")),
    ("ssn", "-", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("phone", "0123456789", re.compile(
        r"(?<![0-9+])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
        r"|(?<![0-9+])(?:\+|00(?=[1-9][0-9]{0,2}[ .-]))[0-9]{1,3}(?:[ .-]?\(0\))?(?:[ .-]?\(?[0-9]{1,4}+\)?){2,7}+(?![0-9])"
        r"|(?<![0-9.,+-])0[1-9](?:[ .-][0-9]{2}){4}(?![0-9]|[.,-][0-9])")),
)
#: Country codes of one digit and of two; all others have three. Fixed values of the numbering plan.
ONE_DIGIT = ("1", "7")
TWO_DIGITS = (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)
#: Titles and the gender that they tell.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mademoiselle": "f",
    "Señor": "m", "Señora": "f", "Señorita": "f", "Sr": "m", "Sra": "f", "господин": "m", "госпожа": "f", "Господин": "m", "Госпожа": "f",
}
TITLE = re.compile(r"\b(" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\b\.?[ \u00a0]")
#: A word of a name: letters, joined by hyphens and apostrophes; the 's of a genitive stays outside.
WORD = r"[^\W\d_](?:[^\W\d_]|(?:-|['’](?!s\b))(?=[^\W\d_]))+(?!\w)"
#: Behind a title: a word, or an initial.
PART = re.compile(rf"[ \u00a0]?(?:({WORD})|([^\W\d_]\.|[^\W\d_](?=[ \u00a0][^\W\d_])))")
MENTION = re.compile(rf"(?<!\w){WORD}")
#: What stands before a full name, with the gender that it tells, and what stands behind one.
BEFORE = {
    "": ("name is", "name:", "Name:", "Author:", "From:", "To:", "Contact:", "Signed,", "signed by", "written by", "wrote to", "spoke to", "spoke with", "talked to", "Regards,", "regards,",
         "Sincerely,", "sincerely,", "Dear", "ich heiße", "schrieb an", "gezeichnet", "je m'appelle", "Nom:", "Nom :", "signé par", "écrit à", "me llamo", "Nombre:", "firmado por", "escribió a", "меня зовут", "Имя:"),
    "m": ("Lieber", "Cher", "Querido", "Estimado", "Уважаемый"),
    "f": ("Liebe", "Chère", "Querida", "Estimada", "Уважаемая"),
}
CUES = {cue: g for g, cues in BEFORE.items() for cue in cues}
CUE = re.compile(r"(?:(?<=\s)|(?<![\s\S]))(" + "|".join(re.escape(c) for c in sorted(CUES, key=len, reverse=True)) + r")[ \u00a0\n]+\Z")
BEHIND = re.compile(r"[ \u00a0](?:wrote|writes|said|says|asked|asks|told|replied|answered|schrieb|schreibt|sagte|sagt|fragte|antwortete|dit|demanda|répondit|écrivit|dijo|preguntó|respondió|escribió|сказал|написал|спросил|ответил)(а?)(?!\w)")
CAPITAL = "A-ZÀ-ÖØ-ÞА-ЯЁ"
REST = r"(?:[^\W\d_]|[-'’](?=[^\W\d_]))+"
NAME = f"[{CAPITAL}]{REST}"
#: Begins with a class of characters, which is searched for fast; what stands before it is looked at behind it.
FULL = re.compile(rf"([{CAPITAL}](?<!\w[{CAPITAL}]){REST})[ \u00a0](?:({NAME}|[{CAPITAL}]\.?)[ \u00a0])?({NAME})(?!\w)")
SALUTED = ("Dear", "Hi", "Hello", "Lieber", "Liebe", "Hallo", "Cher", "Chère", "Bonjour", "Querido", "Querida", "Estimado", "Estimada", "Hola", "Уважаемый", "Уважаемая")
SALUTATION = re.compile(rf"(?:(?<=\s)|(?<![\s\S]))({'|'.join(SALUTED)})[ \u00a0]({NAME}),")
#: Who is greeted without a name.
NOBODY = frozenset("sir madam all team everyone everybody customer friend friends colleague colleagues world folks kollege kollegen kunde freund freunde tous client ami amis todos equipo cliente amigo amigos señor señora".split())
SYLLABLES = {
    "latin": ("ba be bi bo da de di do fa fe fi ga ge go ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va ve vi vo".split(), {"m": "n r s l k".split(), "f": "a ia ina ea ela".split(), "n": "el ey is on ie".split(), "s": "man ner son ley ford".split()}),
    "cyrillic": ("ба бе би бо да де ди до ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со та те ти то ва ве ви во".split(), {"m": "н р с л к".split(), "f": "а ия ина ея ела".split(), "n": "ель ей ис он".split(), "s": "ко ин ов ев ский".split()}),
}


#: Draws in the mention's own length and range, before the space widens.
NARROW = 4


class Entity(NamedTuple):
    kind: str
    value: str  # the normal form
    start: int
    end: int


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(int(c) * (2 - k % 2), 10)) for k, c in enumerate(reversed(body)))
    return str(-total % 10)


def iban_check(country: str, rest: str) -> str:
    number = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{98 - number % 97:02d}"


def phone_parts(text: str) -> tuple[str, str]:
    """The digits of a telephone number that stay (country code, the 0 before an area), and the others.

    A number with and without its country code has the same others. Without a + or 00, eleven digits from 1 on have a country code.
    """
    digits = re.sub("[^0-9]", "", text)
    at = 0
    if text.startswith("+") or text.startswith("00"):
        at = 0 if text.startswith("+") else 2
        at += 1 if digits[at : at + 1] in ONE_DIGIT else 2 if digits[at : at + 2] in TWO_DIGITS else 3
    elif len(digits) == 11 and digits[0] == "1":
        at = 1
    at += digits[at : at + 1] == "0"
    return digits[:at], digits[at:]


def normal(kind: str, text: str) -> str | None:
    """The normal form of a find, or None if its check digits or values rule it out."""
    if kind == "email":
        return text.lower()
    if kind in ("phone", "card", "ssn"):
        digits = re.sub("[^0-9]", "", text)
        if kind == "card" and (not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1]):
            return None
        if kind == "phone":
            own = phone_parts(text)[1]
            return own if 8 <= len(digits) <= 17 and 6 <= len(own) <= 14 else None
        return digits
    if kind == "iban":
        plain = text.replace(" ", "")
        return plain if 15 <= len(plain) <= 34 and iban_check(plain[:2], plain[4:]) == plain[2:4] else None
    if kind == "secret":
        plain = len(text) >= 8 and any(map(str.isalnum, text))
        return text if plain or len(text) >= 4 and any(map(str.isdigit, text)) and any(map(str.isalpha, text)) else None
    return text


def names(text: str) -> list[Entity]:
    """The parts of names by title, cue or salutation, given names by gender and surnames, and where they stand elsewhere in the text."""
    out, kinds = [], {}
    for m in TITLE.finditer(text) if any(t in text for t in TITLES) else ():
        gender, at, parts, words = TITLES[m[1]], m.end(), [], 0
        while words < 3 and (p := PART.match(text, at)) and text[p.start(p.lastindex)].isupper():
            parts.append(p)
            words, at = words + (p.lastindex == 1), p.end()
        while parts and parts[-1].lastindex == 2:  # an initial alone is no name
            parts.pop()
        for k, p in enumerate(parts):
            kind, value = "surname" if k == len(parts) - 1 else f"given_{gender}", p[p.lastindex].casefold()
            out.append(Entity(kind, value, *p.span(p.lastindex)))
            if p.lastindex == 1:
                for name in (value, *(x for x in value.split("-") if len(x) > 1)):
                    kinds.setdefault(name, kind)
    for m in FULL.finditer(text):
        cue, behind = CUE.search(text, max(0, m.start() - 24), m.start()), BEHIND.match(text, m.end())
        if not cue and not behind:
            continue
        gender = cue and CUES[cue[1]] or ("f" if behind and behind[1] else "n")
        for g in (1, 2, 3):
            if m[g] and len(m[g].rstrip(".")) > 1:
                value = m[g].casefold()
                kind = kinds.setdefault(value, "surname" if g == 3 else f"given_{gender}")
                out.append(Entity(kind, value, *m.span(g)))
            elif m[g]:
                out.append(Entity(f"given_{gender}", m[g].rstrip(".").casefold(), m.start(g), m.start(g) + 1))
    for m in SALUTATION.finditer(text) if any(w in text for w in SALUTED) else ():
        if (value := m[2].casefold()) not in NOBODY:
            kind = kinds.setdefault(value, f"given_{CUES.get(m[1]) or 'n'}")
            out.append(Entity(kind, value, *m.span(2)))
    for m in MENTION.finditer(text) if kinds else ():
        at = m.start()
        for word in (m[0],) if m[0].casefold() in kinds else m[0].split("-"):
            if word[:1].isupper() and (value := word.casefold()) in kinds:
                out.append(Entity(kinds[value], value, at, at + len(word)))
            at += len(word) + 1
    return out


def find(text: str | None) -> list[Entity]:
    """The entities of a text by place, none within another."""
    if not text:
        return []
    out = []
    for rank, (kind, needs, pattern) in enumerate(PATTERNS):
        at, held = 0, any(c in text for c in needs)
        while held and (m := pattern.search(text, at)):
            g, at = m.lastindex or 0, m.end()
            start, end = m.span(g)
            if g == 3:  # an unquoted secret: the sentence's mark behind it is none of it
                end = start + len(m[g].rstrip(".,;:!?)]}"))
            if (value := normal(kind, text[start:end])) is not None:
                out.append((start, -end, rank, Entity(kind, value, start, end)))
            else:
                at = m.start() + 1  # what its check digits rule out may hold a find that begins later
    if not text.islower():
        out += [(e.start, -e.end, 99 + k, e) for k, e in enumerate(names(text))]
    found, upto = [], 0
    for *_, e in sorted(out):
        if e.start >= upto:
            found.append(e)
            upto = e.end
    return found


class Stream:
    """Keyed draws for one entity and attempt."""

    def __init__(self, key: bytes, *parts: object):
        self.seed = hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=key, digest_size=32).digest()
        self.n, self.left = 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left = hashlib.blake2b(self.seed + self.n.to_bytes(4, "big")).digest()
            self.n += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n

    def one(self, chars):
        return chars[self.below(len(chars))]

    def like(self, text: str) -> str:
        """Letters for letters and digits for digits, in the same case; text of hex digits stays so. Other scripts get ASCII."""
        lower = "abcdef" if re.fullmatch("[0-9a-f]{8,}", text) else "abcdefghijklmnopqrstuvwxyz"
        sets = (("0", "9", "0123456789"), ("a", "z", lower), ("A", "Z", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        if not text.isascii():
            text = "".join(c if c.isascii() else "A" if c.isupper() else "z" if c.isalpha() else "0" if c.isnumeric() else c for c in text)
        return "".join(next((self.one(s) for a, b, s in sets if a <= c <= b), c) for c in text)


def wider(text: str, more: int) -> str:
    """A pattern for Stream.like with *more* places than *text*, where letters stand for what is no letter or digit."""
    return re.sub("[^0-9A-Za-z]", "z", text) + "z" * more if more else text


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The normal form that stands for the entity of the normal form *value*."""
    s = Stream(key, kind, value, attempt)
    more = 2 * max(0, attempt + 1 - NARROW)  # further characters
    if kind == "email":
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        fixed = 2 if labels[-2:-1] == ["example"] else 1  # reserved names, and the top level, stay
        d = Stream(key, "domain", domain)
        if not more and not re.search("[0-9a-z]", local):
            more = 1
        return s.like(wider(local, more)) + "@" + ".".join([d.like(x) for x in labels[:-fixed]] + labels[-fixed:])
    if kind == "phone":
        return s.one("23456789") + "".join(s.one("0123456789") for _ in range(len(value) - 1 + more))
    if kind == "card":
        body = value[0] + "".join(s.one("0123456789") for _ in range(len(value) - 2 + more))
        return body + luhn_digit(body)
    if kind == "ssn" and more:
        return "".join(s.one("0123456789") for _ in range(7 + more))
    if kind == "ssn":
        return f"{1 + s.below(665):03d}{1 + s.below(99):02d}{1 + s.below(9999):04d}"
    if kind == "iban":
        rest = s.like(value[4:]) + "".join(s.one("0123456789") for _ in range(more))
        return value[:2] + iban_check(value[:2], rest) + rest
    if kind == "ip":
        o = value.split(".")
        if more > 4:  # places beyond 255: no text holds these as addresses
            return ".".join(str(256 + s.below(10 ** min(more // 2, 9))) for _ in range(4))
        if more and o[0] in ("192", "172"):
            o = ["10"]  # the largest of the private ranges
        keep = 1 if o[0] in ("10", "127") else 2 if o[:2] == ["192", "168"] or o[0] == "172" and 16 <= int(o[1]) < 32 else 0
        first = [str(s.one([x for x in range(1, 224) if x not in (10, 127, 172, 192)]))] if not keep else o[:keep]
        return ".".join(first + [str(1 + s.below(254)) for _ in range(4 - len(first))])
    if kind == "access_key":
        return value[:4] + s.like(value[4:] + "A" * more)
    if kind == "secret":
        return s.like(wider(value, more))
    script = "cyrillic" if re.search("[Ѐ-ӿ]", value) else "latin"
    syllables, endings = SYLLABLES[script]
    body = "".join(s.one(syllables) for _ in range(2 + attempt))
    return body + s.one(endings["s" if kind == "surname" else kind[-1]])


def render(kind: str, shown: str, stand_in: str) -> str:
    """*stand_in*, a normal form, as *shown* was written; what it has more stands behind."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(phone_parts(shown)[0] + stand_in if kind == "phone" else stand_in)
        return "".join([next(digits) if c in "0123456789" else c for c in shown] + list(digits))
    if kind == "iban":
        chars = iter(stand_in)
        return "".join([c if c == " " else next(chars) for c in shown] + list(chars))
    if kind == "email":
        (local, _, domain), (own, _, at) = stand_in.rpartition("@"), shown.rpartition("@")
        case = own.ljust(len(local)) + "@" + at
        return "".join(c.upper() if o.isupper() else c for c, o in zip(f"{local}@{domain}", case, strict=True))
    if kind == "surname" or kind.startswith("given"):
        return stand_in.upper() if shown.isupper() and sum(map(str.isalpha, shown)) > 1 else stand_in.capitalize() if shown[0].isupper() else stand_in
    return stand_in


def rewrite(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, list[Entity]]:
    """The text with surrogates, and the entities that were found in *text*."""
    found = find(text)
    out, at = [], 0
    for e in found:
        out += [text[at : e.start], render(e.kind, text[e.start : e.end], surrogate(key, e.kind, e.value, attempts.get((e.kind, e.value), 0)))]
        at = e.end
    return "".join([*out, text[at:]]), found


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, value): the distinct entities of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d.as_py(), k, v) for d, t in zip(batch.column(0), batch.column(1), strict=True) for k, v in sorted({(e.kind, e.value) for e in find(t.as_py())})]
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "kind", "value"), r, strict=True)) for r in rows], schema=pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("value", pa.string())]))

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, kind string, value string")


def attempts(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt) of the entities in *found* that need another draw than the first.

    The rounds end, since each draws from a larger space than the one before.
    """

    def run(kinds: pa.Array, values: pa.Array, tries: pa.Array) -> pa.Array:
        return pa.array([surrogate(key, *x) for x in zip(kinds.to_pylist(), values.to_pylist(), tries.to_pylist(), strict=True)], pa.string())

    draw = F.arrow_udf(run, "string")

    def drawn(df: DataFrame) -> DataFrame:
        return materialize(df.withColumn("stand_in", draw("kind", "value", "attempt")), "drawn")

    now = drawn(found.select("kind", "value").distinct().withColumn("attempt", F.lit(0)))
    originals = now.select(F.col("value").alias("stand_in")).distinct()
    while True:
        first = now.groupBy("stand_in").agg(F.min(F.struct("attempt", "kind", "value")).alias("w"), F.count("*").alias("n")).filter("n > 1")
        lost = now.join(first, "stand_in").filter("NOT (attempt = w.attempt AND kind = w.kind AND value = w.value)").select("kind", "value")
        known = now.join(originals, "stand_in", "left_semi").select("kind", "value")
        again = materialize(lost.unionByName(known).distinct().withColumn("again", F.lit(1)), "again")
        if again.isEmpty():
            return now.filter("attempt > 0").select("kind", "value", "attempt")
        now = drawn(now.drop("stand_in").join(again, ["kind", "value"], "left").select("kind", "value", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")))


RESULT = "struct<text: string, entities: array<struct<kind: string, start: int, end: int>>>"


def replace(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """*docs* with the text's entities replaced, and `entities` (type and place in the old text) added."""
    rows = docs.select(packed(docs), F.col("doc_id").cast("long").alias("key"), docs[f"`{text}`"].alias("data"))
    found = materialize(mentions(rows.select(F.col("key").alias("doc_id"), F.col("data").alias("text"))), "mentions")
    tried = materialize(attempts(found, key), "attempts")
    own = materialize(found.join(tried, ["kind", "value"]).groupBy("doc_id").agg(F.collect_set(F.struct("kind", "value", "attempt")).alias("tried")), "own")
    discard(found, tried)

    def run(texts: pa.Array, tries: pa.Array) -> pa.Array:
        out = []
        for t, own in zip(texts, tries, strict=True):
            if not t.is_valid:
                out.append({"text": None, "entities": []})
                continue
            new, finds = rewrite(t.as_py(), key, {(x["kind"], x["value"]): x["attempt"] for x in own.as_py() or []})
            out.append({"text": new, "entities": [{"kind": e.kind, "start": e.start, "end": e.end} for e in finds]})
        return pa.array(out, pa.struct([("text", pa.string()), ("entities", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))]))

    joined = rows.join(own, F.col("key").eqNullSafe(F.col("doc_id")), "left")
    done = joined.select("row", F.arrow_udf(run, RESULT)("data", "tried").alias("result"))
    return unpacked(done, docs.columns, {text: F.col("result.text"), "entities": F.col("result.entities")})
