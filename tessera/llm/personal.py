"""Personal details inside free text (problem 10).

Method: mentions are found by format and by the words around them. Given names
are learned from the whole corpus: a capitalised word is one if it stands in mid
sentence, after a small letter or as the whole of what a label's colon names,
before at least ``least`` different capitalised words that no further capitalised
word follows. Up to
``MOST_NAMES`` learned words go to every task; beyond that each text gets, by a
join, those it contains.

Masked text keeps the rest of a text as it is. Numbers and dates become
format-preserving Feistel pseudonyms: a keyed permutation of the numbers of the
same length, laid into the same layout, so equal numbers stay equal across
documents and the format stays readable. Numbers are validated first, by the
rules of their kind (check digits, ranges, calendar): a valid number becomes a
valid number of the same kind, with its check digits made anew, and a date a date.
Numbers of no known kind, or wrong ones, are permuted digit for digit. Other kinds
become a placeholder with a keyed 64-bit tag of the value.

Defined cases: null and empty texts have no mention and stay as they are; rows
with a null id are ignored; repeated rows give equal rows, which count once;
where formats overlap the order email, id_number, address, phone, name, date
decides. Dates are masked only, they are no mention of their own in ``find``.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections import Counter
from collections.abc import Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import materialise

MOST_NAMES = 100_000

# Titles, street words, labels.
TITLES = r"Mrs?|Ms|Miss|Mx|Dr|Prof|Sir|Dame|Herrn?|Frau|Mme|Mlle|Monsieur|Madame|Sra?|Srta|Señora?|Don|Doña|Г-н|г-н|Г-жа|г-жа|Господин|господин|Госпожа|госпожа"
ORGANISATIONS = {"works", "institute", "gmbh", "ltd", "inc", "corp", "company", "verlag", "university", "museum"}
NO_GIVEN = {"calle", "avenida", "plaza", "paseo", "street", "road", "lane", "terrace", "rue", "ask", "mail", "id", "isbn", "der", "die", "das", "la", "el", "le", "les", "los", "las", "ул", "г"}

_U, _L = "A-ZÀ-ÖØ-ÞА-ЯЁ", "a-zß-öø-ÿа-яё"
WORD = rf"[{_U}][{_L}{_U}’']*[{_L}{_U}]"
SURNAME = rf"{WORD}(?:-{WORD})*"

EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*"
    r"(?:@|＠|\s?[(\[{<]\s?(?:at|AT|@)\s?[)\]}>]\s?|\sAT\s|\sat\s(?=[A-Za-z0-9-]+(?:\s?[(\[{]\s?(?:dot|DOT)|\s(?:dot|DOT)\s)))"
    r"[A-Za-z0-9-]+(?:(?:\.|\s?[(\[{]\s?(?:dot|DOT|\.)\s?[)\]}]\s?|\s(?:dot|DOT)\s)[A-Za-z0-9-]+)+"
)
# Every gate below lets through at least what its pattern matches.
EMAIL_HINT = ("@", "＠", "dot", "DOT")
EMAIL_AT = re.compile(r"[(\[{<]\s?at\s?[)\]}>]")
EMAIL_CAPITAL_AT = re.compile(r"[\s(\[{<]AT[\s)\]}>]")
#: What each label of an identity number holds, and how far into the label it stands.
ID_HINT = {"ecurity": 8, "SSN": 0, "assport": 1, "ID": 0, "Steuer": 0, "écurité": 1, "asseport": 1, "CNI": 0, "Personalausweis": 0, "usweis": 1, "Reisepass": 0, "identidad": 13, "DNI": 0, "NIE": 0,
           "asaporte": 1, "аспорт": 1, "СНИЛС": 0, "ИНН": 0, "身份": 0, "护照": 0, "旅券": 0, "番号": 0, "マイナンバー": 0}

PHONE = re.compile(
    r"(?<![A-Za-z0-9_.@/#+-])(?:"
    r"(?:\+1[ .-]?|1[ .-])?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]?\d{4}"
    r"|(?:\(\+\d{1,3}\)|\+\d{1,3}|00\d{2,4})[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d[\d .-]{5,14}\d"
    r"|\(?0\d{1,4}\)?[ .]?(?:[/-] ?)?\d[\d .-]{4,12}\d"
    r"|\(\d{2,4}\) ?\d{3,4}[ .-]\d{3,4}|\d{3}[ -]\d{4}[ -]\d{4}|8[ -]\(?\d{3}\)?[ -]\d{3}[ -]?\d{2}[ -]?\d{2}"
    r")(?:,? ?(?:ext\.?|x|extension|доб\.|Durchwahl|poste|分机|内線) ?\d{1,5})?(?![A-Za-z0-9_@]|\.\d)"
)
PHONE_WORD = re.compile(
    r"(?:call|ring|phone|reach|tel|fon|mobil|fax|contact|erreichbar|rufen|kontakt|joignable|appel|tél|teléfono|llam|тел|звон|電話|电话|手机|連絡|联系)[^\n]{0,60}$", re.I
)
PHONE_SURE = re.compile(r"^(?:\(?\+|(?:1[ .-])?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}\b)")
NOT_PHONE = re.compile(r"\b(?:isbn|ticket|catalogue|catalog|no|nr|build|version|v|file|order|server|shelf|row|box|coordinates)[.:]?\s*(?:no\.?\s*)?$", re.I)

ID_WORD = re.compile(
    r"(?:[Ss]ocial [Ss]ecurity(?: [Nn]umber)?(?: on file)?|\bSSN\b|[Pp]assport(?: number| no\.?)?|\bID(?: card| number| no\.?)?\b|[Ss]écurité sociale|[Pp]asseport|\bCNI\b|Ausweisnummer|Ausweis|Reisepass|Personalausweis|Steuer-?ID"
    r"|Documento de identidad|\bDNI\b|\bNIE\b|[Pp]asaporte|[Пп]аспорт|СНИЛС|ИНН|身份号码|身份证号?码?|护照号?码?|旅券番号|番号|マイナンバー)\s*(?:n[o°º]\.?|№)?\s*[:：(]?\s*"
)
ID_VALUE = re.compile(
    r"[12] ?\d\d ?\d\d ?(?:\d\d|2[AB]) ?\d{3} ?\d{3}(?: ?\d\d)?(?!\d)"
    r"|\d{3}[- ]?\d{2}[- ]?\d{4}(?!\d)"
    r"|\d{4} ?(?:№|N) ?\d{6}(?!\d)|\d\d ?\d\d ?(?:№ ?)?\d{6}(?!\d)|\d{3}-\d{3}-\d{3} \d\d(?!\d)"
    r"|\d{4}[- ]\d{4}[- ]\d{4}(?:[- ]\d{3,6})?(?!\d)|\d{17}[\dXx](?!\d)|\d{12,18}(?!\d)"
    r"|[A-Z]{1,2} ?\d{6,9}[A-Z]?(?![\dA-Za-z])|[XYZ]?-?\d{7,8} ?-? ?[A-Z](?![A-Za-z])|[A-Z]\d[A-Z0-9]{7,8}(?![\dA-Za-z])|\d{8,11}(?!\d)"
)

TOWN = rf"{WORD}(?:[ -]{WORD})?"
_EN_TOWN = rf"{WORD}(?:-{WORD})?"
ADDRESS = {
    "en": re.compile(
        rf"(?<![\w/.,-])(?:(?:Flat|Apt\.?|Apartment|Unit) \d+[A-Z]?, )?\d{{1,4}}[A-Z]?(?:/\d+)? {WORD}(?: {WORD})? (?:Street|Road|Lane|Terrace|Avenue|Close|Drive|Square|Court|St\.|Rd\.|Ave\.)(?![\w])"
        rf"(?:, (?:Flat|Apt\.?|Apartment|Unit) \d+[A-Z]?)?(?:, {_EN_TOWN}(?: \d{{5}})?(?![\w]))?"
    ),
    "de": re.compile(rf"(?<!\w)(?:{WORD}(?:gasse|weg|str\.|straße|strasse|platz|allee|ring|ufer)|{WORD}(?:er|sche) (?:Straße|Weg|Platz|Allee)) \d{{1,3}} ?[a-z]?(?![\w])(?:, (?:D-)?\d{{5}} {_EN_TOWN})?"),
    "fr": re.compile(rf"(?<![\w,/-])\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|place|boulevard|chemin|impasse|quai|allée|cours|route) (?:(?:de la|de l'|du|des|de|d')\s?)?{WORD}(?:-{WORD})?(?:, \d{{5}} {_EN_TOWN})?"),
    "es": re.compile(rf"(?<!\w)(?:Calle|Avenida|Plaza|Paseo|Camino|C/|Avda\.?|Pl\.) ?(?:(?:de la|del|de los|de las|de) )?{WORD}, (?:n\.?º ?)?\d{{1,4}}(?:, (?:bajo|ático|\d{{1,2}}\.?º(?: [A-Z](?![\w]))?))?(?:, \d{{5}} {_EN_TOWN})?"),
    "ru": re.compile(rf"(?:\d{{6}}, )?(?:(?:г\. ?|город )?{TOWN}, )?(?:ул\.|улица|пр\.|проспект|пер\.|наб\.) ?{WORD}, (?:д\.|дом) ?\d{{1,4}}[а-я]?(?:, (?:корп\.|стр\.) ?\d+)?(?:, (?:кв\.|квартира) ?\d+)?"),
    "ja": re.compile(r"(?:〒? ?\d{3}-\d{4} ?)?(?:[一-龯々ヶケノ]{1,4}[都道府県])?[一-龯々ヶケノ]{1,6}[市区郡](?:[一-龯々ヶケノ]{1,8}[町村])?[一-龯々]{0,4}\d{1,3}(?:丁目)(?:\d{1,3}番地?)?(?:\d{1,4}号)?(?:室|\d+号室)?"),
    "zh": re.compile(r"(?:\d{6} ?)?(?:[一-龥]{2,4}省)?[一-龥]{2,4}市(?:[一-龥]{1,4}区)?[一-龥]{1,6}(?:路|街|巷|大道)\d{1,5}号(?:\d{1,3}[栋幢])?(?:\d{1,5}[室房])?"),
}
ADDRESS_HINT = {
    "en": ("Street", "Road", "Lane", "Terrace", "Avenue", "Close", "Drive", "Square", "Court", " St.", " Rd.", " Ave."),
    "de": ("gasse ", "weg ", "str. ", "straße ", "strasse ", "platz ", "allee ", "ring ", "ufer ", "Straße ", "Weg ", "Platz ", "Allee "),
    "fr": (" rue ", " avenue ", " place ", " boulevard ", " chemin ", " impasse ", " quai ", " allée ", " cours ", " route "),
    "es": ("Calle", "Avenida", "Plaza", "Paseo", "Camino", "C/", "Avda", "Pl."),
    "ru": ("ул.", "улица", "пр.", "проспект", "пер.", "наб."),
    "ja": ("丁目",),
    "zh": ("号",),
}
DE_NUMBER = re.compile(r"(?:gasse|weg|str\.|straße|strasse|platz|allee|ring|ufer|Straße|Weg|Platz|Allee) \d")
CJK_LEAD = re.compile(r"^(?:住所は|住所|地址|住在|位于|在|至|到|由|于|は|の)")

TITLED = re.compile(rf"(?<![\w])(?:{TITLES})\.? ((?:(?:{WORD}) )??(?:[{_U}]\. ?)*{SURNAME})(?![\w])")
PAIR = re.compile(rf"(?<![\w’'-])({WORD})(?=( (?:[{_U}]\. ?)*)({SURNAME})(?![\w]))")
INITIAL = re.compile(rf"(?<![\w.º])(?:[{_U}]\. ?)+({SURNAME})(?![\w])")
TURNED = re.compile(rf"(?<![\w’'-])({SURNAME}), ({WORD})(?![\w’'-])(?: [{_U}]\.)*")
JA_NAME = re.compile(r"([一-龯々ヶノ]{2,8})(?=さん|氏(?![一-龯])|様(?![一-龯]))")
ZH_TITLES = ("先生", "女士", "小姐", "老师", "博士")
ZH_NAME = re.compile(rf"(?:属于|是|由|找|给|请|问|与|和|为|联系人|[：:，。、“\s])([一-龥]{{2,4}}?)(?={'|'.join(ZH_TITLES)})")


def _pairs_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (given, surname, n): capitalised pairs that can be names, summed by batch."""
    name = rf"({WORD}) (?:[{_U}]\. ?)*({SURNAME})"
    find = re.compile(rf"(?<=[{_L}] ){name}(?=[ ,.;:?!”»)—–<\n]|$)(?! {WORD})|(?<=[{_L}][:：] ){name}(?=[.;\n]|$)")
    for batch in batches:
        n: Counter = Counter()
        for text in batch.column(0).to_pylist():
            for m in find.finditer(text or ""):
                n[m[1] or m[3], m[2] or m[4]] += 1
        n = Counter({k: v for k, v in n.items() if k[1].lower() not in ORGANISATIONS and k[0].lower() not in NO_GIVEN and not re.fullmatch(TITLES, k[0])})
        if n:
            a, b = zip(*n)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(list(n.values()), pa.int64())], names=["given", "surname", "n"])


def given_names(docs: DataFrame, text: str = "text", least: int = 4) -> DataFrame:
    """(given): the given names that the corpus shows, by the number of different surnames after them.

    A surname must itself follow at least two different words, so a word before
    a run of unrelated capitalised words is none.
    """
    seen = docs.select(text).mapInArrow(_pairs_seen, "given string, surname string, n long").groupBy("given", "surname").agg(F.sum("n").alias("n"))
    seen = materialise(seen, "pairs")
    shared = seen.groupBy("surname").agg(F.count("*").alias("firsts")).where("firsts >= 2").select("surname")
    got = seen.join(shared, "surname").groupBy("given").agg(F.count("*").alias("k")).where(F.col("k") >= least)
    return materialise(got.select("given"), "given")


def with_names(docs: DataFrame, key: str, text: str, lang: str, least: int, most: int) -> tuple[DataFrame, list[str]]:
    """((key, text, lang, given) of the rows with a key, names for all).

    Up to ``most`` names are sent along whole and given is null; beyond, each
    distinct text gets its own by joining its capitalised words, in small letters
    as the Finder compares them.
    """
    names = given_names(docs, text, least)
    base = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    if names.limit(most + 1).count() <= most:
        return base.withColumn("given", F.lit(None).cast("array<string>")), sorted(r.given for r in names.collect())
    hashed = base.withColumn("h", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text"))
    words = hashed.select("h", "h2", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(rf"(?<![\p{{L}}’'-])({WORD})(?![\p{{L}}])"), F.lit(1)))).alias("given"))
    words = words.withColumn("given", F.lower("given")).distinct()
    own = words.join(names.select(F.lower("given").alias("given")).distinct(), "given").groupBy("h", "h2").agg(F.collect_set("given").alias("given"))
    return hashed.join(own, ["h", "h2"], "left").select("key", "text", "lang", F.coalesce("given", F.array().cast("array<string>")).alias("given")), []


class Finder:
    """Mentions in one text after another."""

    def __init__(self, given: list[str]):
        self.given = {g.lower() for g in given}

    def _names(self, text: str, lang: str) -> Iterator[tuple[int, int]]:
        known = self.given
        for m in TITLED.finditer(text):
            yield m.span(1)
        if lang == "fr":
            for m in re.finditer(rf"(?<![\w.])M\. ({SURNAME})(?![\w])", text):
                yield m.span(1)
        for m in PAIR.finditer(text):
            if m[1].lower() in known and m[3].lower() not in ORGANISATIONS and m[3].lower() not in known:
                yield m.start(), m.end(3)
        for m in INITIAL.finditer(text):
            w = m[1]
            if len(w) > 2 and w.lower() not in known and w.lower() not in ORGANISATIONS and f" {w.lower()} " not in text and self._initial_fits(text, m):
                yield m.span()
        for m in TURNED.finditer(text):
            if m[2].lower() in known and m[1].lower() not in known and not re.match(rf" (?:[{_U}]\. ?)*{WORD}", text[m.end() : m.end() + 40]):
                yield m.span()
        if "さん" in text or "氏" in text or "様" in text:
            for m in JA_NAME.finditer(text):
                yield m.span(1)
        if any(h in text for h in ZH_TITLES):
            for m in ZH_NAME.finditer(text):
                yield m.span(1)

    @staticmethod
    def _labels(text: str) -> Iterator[re.Match]:
        """The matches of ID_WORD in order, tried only where a hint stands."""
        starts = set()
        for hint, lead in ID_HINT.items():
            at = text.find(hint)
            while at >= 0:
                starts.add(at - lead)
                at = text.find(hint, at + 1)
        end = 0
        for i in sorted(starts):
            if i >= end and (m := ID_WORD.match(text, i)):
                end = m.end()
                yield m

    @staticmethod
    def _initial_fits(text: str, m: re.Match) -> bool:
        """A single initial must not be the end of a sentence or a flat's letter."""
        before = text[max(0, m.start() - 24) : m.start()]
        if re.search(r"(?:º|Flat|Nr\.|№|plan|type|class|Stufe)\s*$", before):
            return False
        return not re.fullmatch(r"(?i)the|a|an|one|two|in|on|at|why|who|about|when|near|with|el|la|los|las|un|una|le|les|der|die|das|ein|eine|laut|etwa|selon|según|кто|это|в|на", m[1])

    def mentions(self, text: str | None, lang: str | None = None) -> list[tuple[str, int, int]]:
        if not text:
            return []
        lang = (lang or "").strip().lower()[:2]
        taken: list[tuple[str, int, int]] = []
        used = bytearray(len(text))

        def take(kind: str, a: int, b: int) -> None:
            if a < b and not any(used[a:b]):
                used[a:b] = b"\x01" * (b - a)
                taken.append((kind, a, b))

        if any(h in text for h in EMAIL_HINT) or EMAIL_AT.search(text) or ("AT" in text and EMAIL_CAPITAL_AT.search(text)):
            for m in EMAIL.finditer(text):
                take("email", *m.span())
        for m in self._labels(text):
            if v := ID_VALUE.match(text, m.end()):
                take("id_number", *v.span())
        for kind, pattern in ADDRESS.items():
            if any(h in text for h in ADDRESS_HINT[kind]) and (kind != "de" or DE_NUMBER.search(text)):
                for m in pattern.finditer(text):
                    a, b = m.span()
                    if kind in ("ja", "zh"):
                        while lead := CJK_LEAD.match(text[a:b]):
                            a += lead.end()
                    take("address", a, b)
        for m in PHONE.finditer(text):
            before = text[max(0, m.start() - 70) : m.start()]
            digits = sum(c.isdigit() for c in m.group())
            if 7 <= digits <= 17 and not NOT_PHONE.search(before) and (PHONE_SURE.match(m.group()) or PHONE_WORD.search(before)):
                take("phone", *m.span())
        for a, b in self._names(text, lang):
            take("name", a, b)
        return sorted(taken, key=lambda x: x[1])


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: int = 4, most_names: int = MOST_NAMES) -> DataFrame:
    """(key, kind, char_start, char_end), one row per mention."""
    rows, given = with_names(docs, key, text, lang, least, most_names)
    kt = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = Finder(given)
        for batch in batches:
            keys, kinds, starts, ends = [], [], [], []
            for k, t, g, own in zip(*(c.to_pylist() for c in batch.columns)):
                for kind, a, b in (whole if own is None else Finder(own)).mentions(t, g):
                    keys.append(k)
                    kinds.append(kind)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["key", "kind", "char_start", "char_end"])

    return rows.mapInArrow(run, f"key {kt}, kind string, char_start int, char_end int").withColumnRenamed("key", key)


# Format-preserving pseudonyms


def _round(secret: bytes, r: int, half: int, modulus: int, tweak: bytes) -> int:
    d = hmac.new(secret, b"%d|%d|" % (r, half) + tweak, hashlib.sha256).digest()
    return int.from_bytes(d[:16], "big") % modulus


def feistel(n: int, length: int, secret: bytes, tweak: bytes = b"", back: bool = False) -> int:
    """A keyed permutation of the numbers of ``length`` decimal digits (alternating Feistel, 10 rounds)."""
    u = length // 2
    low, high = 10 ** (length - u), 10**u
    a, b = divmod(n, low)
    rounds = range(10)
    for r in reversed(rounds) if back else rounds:
        if r % 2 == 0:
            x = _round(secret, r, b, high, tweak)
            a = (a - x if back else a + x) % high
        else:
            x = _round(secret, r, a, low, tweak)
            b = (b - x if back else b + x) % low
    return a * low + b


# Kinds of numbers with rules of their own: what a number's letters and digits look
# like, the places that are permuted, and what the check characters must be.


def _check_es(x: str) -> str:
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(x.translate(str.maketrans("XYZ", "012"))) % 23]


def _check_fr(x: str) -> str:
    return f"{97 - int(x.replace('2A', '19').replace('2B', '18')) % 97:02d}"


def _check_zh(x: str) -> str:
    return "10X98765432"[sum(int(c) * pow(2, 17 - i, 11) for i, c in enumerate(x)) % 11]


def _check_snils(x: str) -> str:
    n = sum(int(c) * (9 - i) for i, c in enumerate(x)) % 101
    return f"{n % 100:02d}"


def _check_ja(x: str) -> str:
    n = sum(int(c) * (k + 1 if k <= 6 else k - 5) for k, c in enumerate(reversed(x), 1)) % 11
    return str(0 if n <= 1 else 11 - n)


def _check_inn(x: str) -> str:
    one = sum(int(c) * w for c, w in zip(x, (7, 2, 4, 10, 3, 5, 9, 4, 6, 8))) % 11 % 10
    two = sum(int(c) * w for c, w in zip(x + str(one), (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8))) % 11 % 10
    return f"{one}{two}"


def _birth(x: str) -> bool:
    try:
        date(int(x[:4]), int(x[4:6]), int(x[6:8]))
    except ValueError:
        return False
    return True


def _always(x: str) -> bool:
    return True


#: name: (pattern of letters and digits; group 1 stays, group 2 is permuted, what follows are check characters), check, rule of the two groups.
SCHEMES = {
    "es_dni": (re.compile(r"()(\d{8})[A-Z]"), _check_es, _always),
    "es_nie": (re.compile(r"([XYZ])(\d{7})[A-Z]"), _check_es, _always),
    "fr_nir": (re.compile(r"([12]\d\d(?:0[1-9]|1[0-2])(?:\d\d|2[AB]))(\d{6})\d\d"), _check_fr, _always),
    "zh_id": (re.compile(r"(\d{6})(\d{11})[\dX]"), _check_zh, lambda x: x[6:8] in ("19", "20") and _birth(x[6:14])),
    "ru_snils": (re.compile(r"()(\d{9})\d\d"), _check_snils, _always),
    "ru_inn": (re.compile(r"()(\d{10})\d\d"), _check_inn, _always),
    "ja_number": (re.compile(r"()(\d{11})\d"), _check_ja, _always),
    "us_ssn": (re.compile(r"()(\d{9})"), lambda x: "", lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"),
}


def validated(value: str) -> str | None:
    """The kind of an identity number whose check digits and ranges hold; None if it is of no known kind or wrong."""
    chars = "".join(c for c in value.upper() if c.isalnum() and c.isascii())
    for name, (pattern, check, rule) in SCHEMES.items():
        m = pattern.fullmatch(chars)
        if m and m[1] + m[2] + check(m[1] + m[2]) == chars and rule(m[1] + m[2]):
            return name
    return None


def laid(value: str, chars: str) -> str:
    """chars in the places of value's ASCII letters and digits."""
    new = iter(chars)
    return "".join(next(new) if c.isalnum() and c.isascii() else c for c in value)


def pseudonym(value: str, kind: str, secret: bytes, back: bool = False) -> str:
    """value with its digits permuted and its layout kept; equal digits give equal digits in any layout.

    A valid identity number becomes a valid one of its kind: the permutation is
    walked on until the kind's rule holds, and the check characters are made anew.
    A country code written with + stays. Fewer than two digits stay as they are.
    """
    scheme = validated(value) if kind == "id_number" else None
    if scheme:
        pattern, check, _ = SCHEMES[scheme]
        m = pattern.fullmatch("".join(c for c in value.upper() if c.isalnum() and c.isascii()))
        x = m[2]
        while True:
            x = str(feistel(int(x), len(x), secret, (scheme + m[1]).encode(), back)).zfill(len(x))
            out = laid(value, m[1] + x + check(m[1] + x))
            if validated(out) == scheme:  # not by chance of a kind that is tried before
                return out
    keep = re.match(r"\(?\+\d{1,3}", value)
    start = keep.end() if keep and kind == "phone" else 0
    digits = [c for c in value[start:] if c in "0123456789"]
    if len(digits) < 2:
        return value
    x = "".join(digits)
    while True:
        x = str(feistel(int(x), len(x), secret, kind.encode(), back)).zfill(len(x))
        new = iter(x)
        out = value[:start] + "".join(next(new) if c in "0123456789" else c for c in value[start:])
        if kind != "id_number" or not validated(out):  # what is valid belongs to the permutation of valid ones
            return out


# The months' names.
MONTHS = {
    "en": "January February March April May June July August September October November December",
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
}
_MONTHS = {k: v.split() for k, v in MONTHS.items()}
_NAMES = "|".join(sorted({m for v in _MONTHS.values() for m in v}, key=len, reverse=True))
_Y, _M, _D = r"(?P<y>(?:19|20)\d\d)", r"(?P<m>\d{1,2})", r"(?P<d>\d{1,2})"
DATES = [
    re.compile(rf"(?<![\w.-]){_Y}(?P<s>[-/.]){_M}(?P=s){_D}(?![\w-]|\.\d)"),
    re.compile(rf"(?<![\w./-]){_D}(?P<s>[-/.]){_M}(?P=s){_Y}(?![\w-]|\.\d)"),
    re.compile(rf"(?<!\d){_Y}年{_M}月{_D}日"),
    re.compile(rf"(?<![\w.]){_D}\.? (?:de )?(?P<n>{_NAMES})(?: de)? {_Y}(?!\w)", re.I),
    re.compile(rf"(?<!\w)(?P<n>{_NAMES}) {_D}(?:st|nd|rd|th)?,? {_Y}(?!\w)", re.I),
]
FIRST, LAST = date(1900, 1, 1), date(2099, 12, 31)


def date_of(m: re.Match) -> tuple[date, str | None] | None:
    """(the date, the language of its month's name) of a match; None if the calendar has no such date.

    Of two numbers, the first is the day unless only the second can be one.
    """
    g = m.groupdict()
    lang, month = None, g.get("m")
    if g.get("n"):
        lang = next(k for k, v in _MONTHS.items() if g["n"].lower() in map(str.lower, v))
        month = [x.lower() for x in _MONTHS[lang]].index(g["n"].lower()) + 1
    for a, b in ((int(month), int(g["d"])), *([(int(g["d"]), int(month))] if g.get("m") and m.start("d") < m.start("m") else [])):
        try:
            return date(int(g["y"]), a, b), lang
        except ValueError:
            continue
    return None


def date_pseudonym(d: date, secret: bytes, first: date = FIRST, last: date = LAST, back: bool = False) -> date:
    """A keyed permutation of the dates from first to last (cycle walking)."""
    size = (last - first).days + 1
    n, length = (d - first).days, len(str(size))
    while True:
        n = feistel(n, length, secret, b"date", back)
        if n < size:
            return first + timedelta(days=n)


def date_text(m: re.Match, secret: bytes, back: bool = False) -> str | None:
    """The match with its date permuted, in its own layout and language; None if it is no date."""
    got = date_of(m)
    if not got:
        return None
    d, lang = date_pseudonym(got[0], secret, back=back), got[1]
    parts = {"y": f"{d.year:04d}", "d": f"{d.day:02d}" if m["d"][0] == "0" or len(m["d"]) == 2 else str(d.day)}
    if lang:
        name = _MONTHS[lang][d.month - 1]
        parts["n"] = name.upper() if m["n"].isupper() and len(m["n"]) > 1 else name.capitalize() if m["n"][0].isupper() else name.lower()
    else:
        parts["m"] = f"{d.month:02d}" if m["m"][0] == "0" or len(m["m"]) == 2 else str(d.month)
    out, at = [], m.start()
    for k in sorted(parts, key=m.start):
        out += [m.string[at : m.start(k)], parts[k]]
        at = m.end(k)
    return "".join(out) + m.string[at : m.end()]


def dates(text: str | None, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, re.Match]]:
    """('date', start, end, match) of the dates that touch none of the mentions taken."""
    out: list[tuple[str, int, int, re.Match]] = []
    for p in DATES if text else ():
        for m in p.finditer(text):
            a, b = m.span()
            if date_of(m) and all(y <= a or x >= b for _, x, y, *_ in taken) and all(y <= a or x >= b for _, x, y, _ in out):
                out.append(("date", a, b, m))
    return out


def masked(text: str, mentions: list[tuple[str, int, int]], secret: bytes) -> tuple[str, int]:
    """(text with placeholders, their number): mentions and dates as ``[KIND:pseudonym or tag]``."""
    out, at = [], 0
    every = sorted([*((*m, None) for m in mentions), *dates(text, mentions)], key=lambda x: x[1])
    for kind, a, b, m in every:
        value = text[a:b]
        if kind in ("phone", "id_number"):
            new = pseudonym(value, kind, secret)
        elif kind == "date":
            new = date_text(m, secret)
        else:
            new = hmac.new(secret, (kind + "|" + " ".join(value.lower().split())).encode(), hashlib.sha256).hexdigest()[:16]
        out += [text[at:a], f"[{kind.upper()}:{new}]"]
        at = b
    return "".join(out) + text[at:], len(every)


def mask(docs: DataFrame, secret: bytes, key: str = "doc_id", text: str = "text", lang: str = "lang", least: int = 4, most_names: int = MOST_NAMES) -> DataFrame:
    """(key, text, n_mentions) of every row with a key; null texts stay null."""
    rows, given = with_names(docs, key, text, lang, least, most_names)
    kt = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = Finder(given)
        for batch in batches:
            texts, counts = [], []
            for t, g, own in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                got = (whole if own is None else Finder(own)).mentions(t, g)
                new, n = masked(t, got, secret) if t else (t, 0)
                texts.append(new)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["key", "text", "n_mentions"])

    return rows.mapInArrow(run, f"key {kt}, text string, n_mentions int").withColumnRenamed("key", key)
