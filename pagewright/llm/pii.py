"""Problem 8: personal strings in free text, by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs and their disguises, address schemes
(mailto:, tel: and the like), words that announce an identifier, digits that begin a
number, street and box words, and given names. At each anchor a deterministic local parser
expands to the string's boundaries, as far as its grammar goes, and validates it.
The automaton is built once on each executor from bounded lists.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.lexicon import plain_ascii
from pagewright.llm.tables import bounded_rows, read_table, tune

KINDS = ("email", "phone", "id_number", "address", "name")
#: The members of the House are a small fixed table; collected with this bound checked.
MOST_MEMBERS = 50_000

# --- local parsers -------------------------------------------------------------------

_AT = r"(?:@|[ \t]@[ \t]|[ \t]?[\[(\{][ \t]?(?:at|a|arroba|arobase|ät)[ \t]?[\])\}][ \t]?|[ \t](?:AT|arroba|arobase)[ \t])"
_DOT = r"(?:\.|[ \t]?[\[(\{][ \t]?(?:dot|punkt|point|punto)[ \t]?[\])\}][ \t]?|[ \t](?:DOT|punto)[ \t])"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+'-]*[A-Za-z0-9+_-])?$")
_MAIL_REST = re.compile(rf"{_AT}({_LABEL}(?:{_DOT}{_LABEL})+)", re.I)
_SPELLED_REST = re.compile(rf"[ \t]at[ \t]({_LABEL}(?:[ \t]dot[ \t]{_LABEL})+)(?![A-Za-z0-9])", re.I)

_GAP = r"[ \t  .\-/]"
_PHONE = re.compile(rf"(?:(?:\+|00)[1-9]\d{{0,2}}{_GAP}?(?:\(0\){_GAP}?)?|\(0\d{{1,4}}\){_GAP}?|0[1-9]?\d{{1,3}}{_GAP}|0)\d{{1,4}}(?:{_GAP}?\d{{2,7}}){{1,5}}(?!\d)")
_DIALLED = re.compile(rf"\+?\d(?:{_GAP}?\d)*")
_NOT_PHONE = re.compile(
    r"(?:document|motion|line|clause|bill|paper|report|vote|votes|voted|petition|question|account|titel|haushaltstitel|drucksache|antrag|artikel|paragraf|dokument|document|ligne budgétaire|budgétaire|amendement|documento|moción|partida|ley|enmienda|column|page|no\.|nr\.|n\.º|of the)\s*$",
    re.I,
)
_NOT_PHONE_AFTER = re.compile(r"^[ \t]*(?:crowns?|kronen|couronnes|coronas|euros?|million|votes|stimmen|voix|votos|people|households)\b", re.I)

_IDS = (
    re.compile(r"[A-Z]{2} \d{2} \d{2} \d{2} \d{3} [A-Z](?![A-Za-z0-9])"),
    re.compile(r"[A-Z]{2}[ \-]?\d{7,9}(?![A-Za-z0-9\-])"),
    re.compile(r"\d{2}\.\d{3}\.\d{3}-[\dKk](?![A-Za-z0-9])"),
    re.compile(r"\d{6}[-+]\d{4}(?![\d\-/])"),
    re.compile(r"\d{2} \d{3} \d{3} \d{3}(?! ?\d)"),
    re.compile(r"(?!555|000)\d{3}-\d{2}-\d{4}(?![\d\-])"),
)
#: Words that announce a personal identifier, in lower case; they are anchors in lower case, with a capital, and in capitals.
ID_CUES = (
    "passport", "identity", "national", "personal", "person", "personen", "social security", "tax", "insurance", "ausweis", "pass", "steuer", "identité", "identidad", "passeport", "pasaporte", "fiscal",
    "number is", "under", "nummer", "id no", "ssn",
)
#: What may stand between such a word and the identifier: the rest of a compound, up to three more words, a colon or verb.
_CUE_GAP = re.compile(r"\w*(?:[ \t]\w+){0,3}\W{0,4}(?:is|was|under)?\W{0,3}")
#: Characters that such a gap can have at most: its grammar with words of any usual length.
CUE_REACH = 80
_ID_LOOSE = re.compile(r"(?=[A-Z0-9 .\-/]*\d[A-Z0-9 .\-/]*\d[A-Z0-9 .\-/]*\d[A-Z0-9 .\-/]*\d[A-Z0-9 .\-/]*\d)(?:[A-Z]{1,3}[ \-]?)?\d[\d .\-/]{4,18}\d(?:[ \-]?[A-Z](?![A-Za-z]))?(?!\d)")

_TOWN = r"[A-ZÀ-Þ][\w'’-]+(?:[ \t-][A-ZÀ-Þ][\w'’-]+)?"
_NUMBER = r"\d{1,5}[A-Za-z]?"
#: The name of a street after its type: up to twelve words of any length.
_STREET_NAME = r"(?:[\w'’.()/-]+[ \t]){0,11}[\w'’.()/-]+"
_UK_CODE = r"[A-Z]{1,2}\d[\dA-Z]?[ \t]?\d[A-Z]{2}(?![A-Za-z0-9])"
_EN_TYPES = "Street|Road|Lane|Avenue|Close|Hill|Row|Drive|Court|Square|Terrace|Gardens|Crescent|Place|Way|Walk|Mews|Grove|Park|Green|Quay|Yard|Parade|Rise"
_EN_TOWN = rf"[A-ZÀ-Þ][a-zà-ÿ'’-]+(?:[ \t-][A-ZÀ-Þ][a-zà-ÿ'’-]+)?"
ADDRESSES = {
    "en": re.compile(
        rf"(?:(?:Flat|Apartment|Apt\.?|Unit)[ \t]{_NUMBER},?[ \t])?{_NUMBER},?[ \t](?:St\.[ \t])?(?:[A-ZÀ-Þ][\w'’.-]*[ \t]){{1,3}}(?:{_EN_TYPES}),[ \t]{_EN_TOWN}(?:,?[ \t]{_UK_CODE})?"
    ),
    "box": re.compile(rf"(?:P\.?[ \t]?O\.?[ \t]?Box|PO[ \t]Box|Postfach|Apartado(?: de correos)?|B\.?P\.?|Boîte postale)[ \t]\d[\d ]{{0,6}}\d?,?[ \t](?:\d{{4,5}}[ \t])?{_EN_TOWN}(?:,?[ \t]{_UK_CODE})?"),
    "de": re.compile(rf"(?:(?:Am|An der|An den|Im|In der|Zum|Zur|Auf der|Auf dem|Alte|Neue|Große|Kleine)[ \t])?[A-ZÄÖÜ][\wäöüß.-]*(?:[ \t](?:Straße|Weg|Platz|Allee|Gasse|Ring|Ufer|Damm))?[ \t]{_NUMBER},[ \t]\d{{4,5}}[ \t]{_TOWN}"),
    "fr": re.compile(rf"\d{{1,5}}(?:[ \t](?:bis|ter|quater))?,?[ \t](?:rue|avenue|impasse|boulevard|place|chemin|quai|allée|route|cours|passage|ruelle|sentier|square|faubourg)[ \t]{_STREET_NAME},[ \t]\d{{5}}[ \t]{_TOWN}", re.I),
    "es": re.compile(rf"(?:Calle|Avenida|Plaza|Paseo|Camino|Carrera|Ronda|Travesía|Callejón|C/|Avda\.)[ \t]{_STREET_NAME},[ \t](?:n\.?º?[ \t])?{_NUMBER}(?:,[ \t]\d{{1,2}}\.?[ºª°][ \t]?[A-Za-z]*)?,[ \t]\d{{5}}[ \t]{_TOWN}"),
}
_PARTICLES = "van der|van den|van de|van|von der|von|vom|zu|de la|de las|de los|de|del|du|des|della|di|da|dos|ter|ten|le|la"
_PARTICLE_WORDS = frozenset(_PARTICLES.replace("|", " ").split())
_PARTICLE = rf"(?:{_PARTICLES}|{_PARTICLES.upper()})(?!\w)"
_FAMILY = r"[A-ZÀ-Þ][\w'’]+(?:-[A-ZÀ-Þ][\w'’]+)*"
_NAME_REST = re.compile(rf"(?:[ \t][A-ZÀ-Þ]\.)*(?:[ \t]{_PARTICLE})*[ \t]{_FAMILY}")
_GIVEN = re.compile(r"[A-ZÀ-Þ][\w'’]+(?:-[A-ZÀ-Þ][\w'’]+)?")
_INSTITUTION = re.compile(r"^(?:['’]s)?[ \t](?:Foundation|Hospital|Institute|report|Report|Act|Bill|Prize|Award|School|College|Centre|Center|Trust|Museum|Library|Fund|Society|Bridge|Commission|Committee|inquiry|Inquiry|Stiftung|Fondation|Fundación|Krankenhaus)\b")
_TITLE_CASE = re.compile(r"[A-ZÀ-Þ][a-zà-ÿ]")
#: A name cannot begin after these.
_TOWN_LIKE = re.compile(r"(?:\d |St\. |St )$")
_LETTER = re.compile(r"\w")
_ARTICLES = frozenset("bis ter quater der den dem die das am an im in auf zum zur de la le les du des del los las".split())

_CUED_NAME = re.compile(rf"{_GIVEN.pattern}(?:[ \t][A-ZÀ-Þ]\.)*(?:[ \t]{_PARTICLE})*[ \t]{_FAMILY}")
#: A name right before an address or telephone number and what may stand between.
_NAME_BEFORE = re.compile(rf"(?<![\w.'’-]){_CUED_NAME.pattern}$")
_BETWEEN = re.compile(r"(?:, | \(| / |: |, (?:tel|Tel|tél)\. | of )$")
#: Capitalised words that begin a sentence and are no given name.
_NO_GIVEN = frozenset("the in a an of at on by to from for and but or der die das ein eine im am le la les un une el los las un una this that these mr ms mrs dr madam sir herr frau monsieur madame señor señora clause document motion budget petition case address contact witness reference".split())

STREET_WORDS = (*_EN_TYPES.split("|"), "straße", "Straße", "strasse", "weg ", "gasse ", "platz ", "allee ", "Am ", "An der ", "Im ", "In der ", "Zum ", "Zur ", "rue ", "avenue ", "impasse ", "boulevard ", "place ", "chemin ", "quai ", "allée ", "Rue ", "Avenue ", "Calle ", "Avenida ", "Plaza ", "Paseo ", "Camino ", "Ronda ", "C/", "Box ", "Postfach ", "Apartado ", "BP ", "B.P. ")


#: Schemes of links and the parser that reads what follows them.
SCHEMES = {"mailto:": "mailto", "tel:": "tel", "callto:": "tel", "sms:": "tel", "fax:": "tel", "whatsapp:": "tel"}
#: Longest local part of a mail address (RFC 5321).
LOCAL_PART = 64
#: Words that an address can have before its street word at most: flat, number, saint, three of the name, and an article.
ADDRESS_WORDS = 8
_SPACES = " \t"


class Finder:
    """Finds personal strings; built from the given names and full names of the members of the House."""

    def __init__(self, members: Iterable[str]):
        import ahocorasick

        full = [" ".join(m.split()) for m in members if m and len(m.split()) >= 2]
        self.members = {_key(m) for m in full}
        self.given = sorted({m.split()[0] for m in full})
        machine = ahocorasick.Automaton()

        def add(word: str, kind: str) -> None:
            kinds = machine.get(word, ((), ""))[0]
            if kind not in kinds:
                machine.add_word(word, ((*kinds, kind), word))

        for sign in ("@", "[at]", "(at)", "{at}", " at ", " AT ", "arroba", "arobase", "(a)", "[a]", "[AT]", "(AT)"):
            add(sign, "mail")
        for digit in "0123456789":
            add(digit, "digit")
        for word in STREET_WORDS:
            add(word, "street")
        for name in self.given:
            add(name, "given")
            add(name.upper(), "given")
        for cue in ID_CUES:
            for form in {cue, cue.capitalize(), cue.title(), cue.upper()}:
                add(form, "id")
        for scheme, kind in SCHEMES.items():
            add(scheme, kind)
            add(scheme.upper(), kind)
            add(scheme.capitalize(), kind)
        machine.make_automaton()
        self.machine = machine

    def spans(self, text: str, speaker: str | None = None) -> list[tuple[int, int, str]]:
        """Disjoint (start, end, kind), in order. Longer readings win over shorter ones that overlap them."""
        found: list[tuple[int, int, str]] = []
        own = _key(re.sub(r"\(.*?\)", "", speaker)) if speaker else ""
        streets: set[int] = set()
        cues: list[int] = []  # ends of the last words that announce an identifier
        for end, (kinds, word) in self.machine.iter(text):
            start = end - len(word) + 1
            for kind in kinds:
                hit = None
                if kind == "mail":
                    hit = _mail(text, start, word)
                elif kind == "digit":
                    if start == 0 or not text[start - 1].isdigit():
                        hit = _number(text, start, cues)
                elif kind == "id":
                    cues = [c for c in cues if end - c < CUE_REACH] + [end + 1]
                elif kind == "street":
                    hit = _address(text, start, streets)
                elif kind == "given":
                    hit = self._name(text, start, end + 1, own)
                elif kind == "mailto":
                    at = text.find("@", end + 1, end + 2 + LOCAL_PART)
                    hit = _mail(text, at, "@") if at >= 0 else None
                else:
                    hit = _dialled(text, end + 1)
                if hit:
                    found.append(hit)
                    if hit[2] in ("address", "phone") and (gap := _BETWEEN.search(text, max(0, hit[0] - 8), hit[0])):
                        name = self._before(text, gap.start(), own)
                        if name:
                            found.append(name)
        return _disjoint(found)

    def _name(self, text: str, start: int, end: int, own: str) -> tuple | None:
        if start and (_LETTER.match(text[start - 1]) or text[start - 1] in "'’-.@+") or text[end : end + 1] in ("-", "'", "’"):
            return None
        rest = _NAME_REST.match(text, end)
        return self._valid(text, start, rest.end(), own) if rest else None

    def _before(self, text: str, end: int, own: str) -> tuple | None:
        """A full name that ends at ``end``: words are taken back as long as they may belong to one."""
        start = end
        while start > 0 and text[start - 1] not in _SPACES + "\n":
            word = start
            while word > 0 and (text[word - 1].isalnum() or text[word - 1] in "'’.-"):
                word -= 1
            if word == start or not (text[word].isupper() or text[word:start].lower() in _PARTICLE_WORDS):
                break
            start = word
            if start > 0 and text[start - 1] in _SPACES:
                start -= 1
            else:
                break
        hit = _NAME_BEFORE.search(text, start, end)
        return self._valid(text, hit.start(), end, own) if hit else None

    def _valid(self, text: str, start: int, end: int, own: str) -> tuple | None:
        name = text[start:end]
        for tail in ("'s", "’s"):
            if name.endswith(tail):
                end -= len(tail)
                name = name[: -len(tail)]
        key = _key(name)
        if name.split()[0].lower() in _NO_GIVEN or _TOWN_LIKE.search(text[max(0, start - 4) : start]):
            return None
        if key in self.members or key == own or _INSTITUTION.match(text[end : end + 24]):
            return None
        return start, end, "name"


def _key(name: str) -> str:
    """A name for comparing: given and family name in lower case, without accents, initials and doubled letters."""
    words = [w for w in plain_ascii(name).lower().split() if not re.fullmatch(r"\w\.?", w)]
    return re.sub(r"(\w)\1", r"\1", " ".join(words)).strip(" .,:")


def _mail(text: str, start: int, word: str) -> tuple | None:
    at = start
    spelled = word.strip().lower() == "at" and word[0] == " "
    while at > 0 and text[at - 1] in " \t" and not spelled:
        at -= 1
    local = _LOCAL_TAIL.search(text, max(0, at - LOCAL_PART), at)
    if not local:
        return None
    rest = (_SPELLED_REST if spelled else _MAIL_REST).match(text, at)
    if not rest:
        return None
    domain = rest.group(1)
    top = re.split(r"[^A-Za-z0-9]+", domain)[-1]
    if not (2 <= len(top) <= 24 and top.isalpha()):
        return None
    return local.start(), rest.end(), "email"


def _dialled(text: str, start: int) -> tuple | None:
    """The telephone number right after a scheme."""
    hit = _PHONE.match(text, start) or _DIALLED.match(text, start)
    return (hit.start(), hit.end(), "phone") if hit and 7 <= sum(c.isdigit() for c in hit.group()) <= 15 else None


def _announced(text: str, first: int, cues: list[int]) -> bool:
    """Whether one of the words that announce an identifier, which end at ``cues``, stands before ``first`` with nothing but its gap between."""
    return any(c <= first and _CUE_GAP.fullmatch(text, c, first) for c in cues)


def _number(text: str, start: int, cues: list[int]) -> tuple | None:
    """An identity number or telephone number whose first digit is at ``start``."""
    before = text[start - 1] if start else " "
    letters = start
    while letters > 0 and start - letters < 3 and "A" <= text[letters - 1] <= "Z":
        letters -= 1
    if letters == start and before in " -" and start >= 3 and text[start - 3 : start - 1].isalpha() and text[start - 3 : start - 1].isupper():
        letters = start - 3
    for first in {letters, start}:
        if first and (_LETTER.match(text[first - 1]) or text[first - 1] in "-./@+") and first == letters:
            continue
        for k, pattern in enumerate(_IDS):
            hit = pattern.match(text, first)
            if not hit or first == start and _LETTER.match(before):
                continue
            context = text[max(0, first - 40) : first]
            if _NOT_PHONE.search(context) or _NOT_PHONE_AFTER.match(text[hit.end() : hit.end() + 20]) or first == start and before in "-/.":
                continue
            return first, hit.end(), "id_number"
    for begin in (start - 1, start) if before in "+(" else (start,):
        if begin and (_LETTER.match(text[begin - 1]) or text[begin - 1] in "-./" or text[begin - 1] == ":" and text[max(0, begin - 2)].isdigit()):
            continue
        context = text[max(0, begin - 44) : begin]
        hit = _PHONE.match(text, begin)
        if hit:
            digits = re.sub(r"\D", "", hit.group().replace("(0)", ""))
            international = hit.group()[0] == "+" or hit.group().startswith("00")
            fits = 9 <= len(digits) <= 15 if international else 9 <= len(digits) <= 12
            if fits and not _NOT_PHONE.search(context) and not _NOT_PHONE_AFTER.match(text[hit.end() : hit.end() + 20]):
                return begin, hit.end(), "phone"
    if before in "-./:":
        return None
    if _announced(text, start, cues) or _announced(text, letters, cues):
        hit = _ID_LOOSE.match(text, letters)
        if hit and 6 <= sum(c.isdigit() for c in hit.group()) <= 14 and not _NOT_PHONE_AFTER.match(text[hit.end() : hit.end() + 20]):
            return letters, hit.end(), "id_number"
    return None


def _starts(text: str, anchor: int):
    """Where an address with a street word at ``anchor`` may begin: at the word there, and at up to `ADDRESS_WORDS` names, numbers and articles before it."""
    at = anchor
    while at > 0 and text[at - 1].isalnum():
        at -= 1
    yield at
    for _ in range(ADDRESS_WORDS):
        end = at
        while end > 0 and text[end - 1] in " \t,":
            end -= 1
        start = end
        while start > 0 and (text[start - 1].isalnum() or text[start - 1] in "'’.-/"):
            start -= 1
        if start == end or end == at or not (text[start].isupper() or text[start].isdigit() or text[start:end].lower() in _ARTICLES):
            return
        at = start
        yield at


def _address(text: str, anchor: int, done: set) -> tuple | None:
    """The longest address around a street or box word at ``anchor``, within its line."""
    best = None
    for start in _starts(text, anchor):
        if start and _LETTER.match(text[start - 1]):
            continue
        for pattern in ADDRESSES.values():
            hit = pattern.match(text, start)
            if hit and hit.end() > anchor and (best is None or hit.end() - hit.start() > best[1] - best[0]):
                best = (hit.start(), hit.end(), "address")
    if best is None or best[0] in done:
        return None
    done.add(best[0])
    return best


def _disjoint(found: list) -> list:
    """The spans in order, longer ones first where two overlap."""
    kept: list[tuple[int, int, str]] = []
    for span in sorted(set(found), key=lambda s: (s[0] - s[1], s[0])):
        at = bisect_left(kept, span)
        if (at == 0 or kept[at - 1][1] <= span[0]) and (at == len(kept) or kept[at][0] >= span[1]):
            kept.insert(at, span)
    return kept


def redact(text: str, spans: list) -> str:
    """``text`` with each span replaced by its placeholder, such as [EMAIL]; the rest stands as it was."""
    out, last = [], 0
    for start, end, kind in spans:
        out += [text[last:start], f"[{kind.upper()}]"]
        last = end
    return "".join([*out, text[last:]])


# --- Spark ---------------------------------------------------------------------------

_FOUND = T.StructType(
    [
        T.StructField("found", T.ArrayType(T.StructType([T.StructField("pii_kind", T.StringType()), T.StructField("pii_text", T.StringType())]))),
        T.StructField("redacted", T.StringType()),
    ]
)


def finder_stage(members: list[str]):
    """The Arrow-batched finder over (text, speaker): personal strings and the redacted text. Null text gives none and null."""
    memo: list[Finder] = []

    def run(text: pd.Series, speaker: pd.Series) -> pd.DataFrame:
        if not memo:
            memo.append(Finder(members))
        rows = []
        for t, s in zip(text, speaker):
            if not isinstance(t, str):
                rows.append(([], None))
                continue
            spans = memo[0].spans(t, s if isinstance(s, str) else None)
            rows.append(([{"pii_kind": k, "pii_text": t[a:b]} for a, b, k in spans], redact(t, spans)))
        return pd.DataFrame(rows, columns=["found", "redacted"])

    return F.pandas_udf(run, _FOUND).asNondeterministic()


def searched(spark: SparkSession, base: str) -> DataFrame:
    """doc_id, found and redacted of each document. Rows with a null doc_id have no identity and are left out."""
    tune(spark)
    names = [r["full_name"] for r in bounded_rows(read_table(spark, base, "members").select("full_name"), MOST_MEMBERS, "members")]
    documents = read_table(spark, base, "documents").where(F.col("doc_id").isNotNull())
    return documents.select("doc_id", finder_stage(names)("text", "speaker").alias("hit")).select("doc_id", "hit.*")


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id, pii_kind, pii_text), distinct. Null and empty texts have none; an empty members' table leaves names to their cues."""
    rows = searched(spark, base).select("doc_id", F.explode("found").alias("f"))
    return rows.select("doc_id", "f.pii_kind", "f.pii_text").distinct()


def p8_redacted(spark: SparkSession, base: str) -> DataFrame:
    """Each document with typed placeholders in place of its personal strings, and their number."""
    return searched(spark, base).select("doc_id", F.col("redacted").alias("clean_text"), F.size("found").alias("replaced"))
