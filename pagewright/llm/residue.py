"""Problem 4: template residue, filler, error and script notices, by a classifier of every title and sentence.

Each title and each sentence of each text becomes hashed word n-grams plus its length, how
much prose its page holds, and what is special to titles; an L2-regularised logistic
regression decides whether it is residue, and a record is residue if one of them is. No
pattern takes part in that decision: status lines, set phrases and the setting of
placeholders only give the weak labels that the classifier is trained on, on a bounded
sample, and most sentences have none but that of their page.
"""

from __future__ import annotations

import re

import numpy as np

from pagewright.llm.blocks import BAD, Block
from pagewright.llm.lexicon import fold, tidy
from pagewright.llm.linear import END, Stretches, codes_of, score, tokens_of

#: Words of prose up to which a page counts as empty, small, thin and short.
SIZES = (12, 45, 70, 140)
#: Words of a sentence of more than this many are prose even where no full stop ends it; with one, of so many.
LONG_SENTENCE, ENDED_SENTENCE = 22, 12

# --- weak labels: patterns of the training alone --------------------------------------

#: A form's closing sign may stand at any distance; each form stops at its own opening sign, so a search stays linear.
PLACEHOLDER = re.compile(
    r"\{\{[^{}]*\}\}|\{%[^{}]+%\}|[$#]\{[^{}]*\}|<%[^<>]+%>|\[\[[^\[\]]+\]\]|%%\w+(?:[.-]\w+)*%%|(?<![\w%])%[A-Za-z_]{3,}%(?!\w)"
    r"|@@\w+(?:[.-]\w+)*@@|\*\|[^|]+\|\*|(?<!\w)__(?![A-Za-z]__)[A-Za-z]+(?:(?:\.|__?)[A-Za-z]+)*__(?!\w)|\[(?:INSERT|YOUR|ENTER|ADD)\b(?:[^\[\]]++|\[[^\[\]]*\])+\]"
    r"|(?<![\w{$#^\\])\{[A-Za-z0-9_]+(?:[.-][A-Za-z0-9_]+)*\}(?!\})",
)
MISSING = re.compile(r"(?<![\w.\"'`])(?:undefined|null|NaN|None|nil|\[object Object\])(?![\w\"'`(])")
_STATUS_WORDS = r"not found|forbidden|access denied|unauthori[sz]ed|bad (?:gateway|request)|service (?:temporarily )?unavailable|internal (?:server )?error|gateway timeout|too many requests|gone"
_STATUS = re.compile(
    rf"^(?:error|fehler|erreur|http(?: status)?)\s*[:#-]?\s*[45]\d\d\b|^[45]\d\d(?:\s*[-:|–]?\s*(?:error|{_STATUS_WORDS})\b.*)?$|^(?:{_STATUS_WORDS})(?:$|\s*[-:|–])|\b(?:page|site) not found\b"
    r"|^(?:just a moment|loading|untitled|attention required|maintenance|error|fehler|erreur)\W*$"
    r"|^(?:seite nicht gefunden|nicht gefunden|zugriff verweigert|page (?:introuvable|non trouvée)|accès (?:refusé|interdit)|página no encontrada|no encontrad[ao]|acceso denegado|en mantenimiento|wartung(?:sarbeiten)?)\b",
)
_PHRASES = re.compile(
    r"checking your browser|enable javascript to|(?:java)?scripts? (?:is|are) (?:turned off|disabled|required|blocked)|turn on (?:java)?scripts? (?:and cookies )?to (?:view|see|use|continue|read)"
    r"|browser is not supported|switch scripts on|allow scripts and reload|blocks? scripts|down for maintenance|back soon|temporarily unavailable|was not found on (?:this|the) server|can.t find the page|page you were looking for"
    r"|may have moved|typed wrongly|don.t have permission|access (?:is|was) denied|no longer available|error establishing|something went wrong|too many requests|rate limited|stack trace|fatal error|on line \d+|unexpected error|incident [0-9a-f]{6,}|reference [0-9a-f]{6,}"
    r"|javascript.{0,20}(?:aktivieren|einschalten|benötigt)|aktivieren sie|skripte.{0,30}(?:läuft|blockiert|aktivier|ein)|browser.{0,12}(?:wird geprüft|blockiert|prüf)|wegen wartung|zurzeit nicht erreichbar|gibt es (?:leider )?nicht mehr|dürfen .{1,60} nicht ansehen|interner fehler|ein fehler ist"
    r"|navigateur (?:bloque|n)|vérification de votre navigateur|activez|indisponible|page (?:demandée|n.existe|introuvable)|une erreur|n.avez pas (?:le droit|la permission)|trop de requêtes"
    r"|(?:activer|autoriser|activar|habilit\w+|permit\w+) (?:les |los |el )?(?:java)?scripts?|scripts? (?:désactivés?|desactivados?|deshabilitados?|deaktiviert)|(?:java)?skripte? (?:erlauben|zulassen|aktivieren)|page (?:que vous cherchez|non trouvée)|seite (?:wurde )?nicht gefunden|no disponible|zu viele anfragen|vorübergehend|temporairement|temporalmente"
    r"|su navegador|active (?:java)?scripts?|mantenimiento|no se (?:ha )?encontr|ya no existe|ha ocurrido un error|no tiene permiso|demasiadas (?:solicitudes|peticiones)|comprobando",
)
#: A notice that only the comments need scripts is site furniture.
_COMMENTS = re.compile(r"\bcomment|\bkommentar|\bcomentario")
_DUMMY = re.compile(
    r"(?:dummy|placeholder|sample|filler) text|write a (?:short )?(?:paragraph|description|sentence) about|sample (?:copy|content)|(?:copy|text|content) (?:and )?(?:that )?will be replaced|add (?:a|your) (?:description|title|text|caption)|(?:click|tap) (?:here )?to edit|title of this (?:block|section)|describe your (?:business|company)|hier steht ihr|titel dieses|fügen sie (?:hier|eine)|titre de ce|ajoutez (?:ici|une)|título de este|añada (?:aquí|una)|texto de muestra|(?:your|this) text (?:here|goes)|replace this text|text goes here|blindtext|platzhaltertext|ihr text|(?:faux|votre) texte|texte (?:ici|à remplacer|de remplissage)|texto (?:de relleno|de ejemplo|aquí|simulado)|su texto|lorem ipsum"
)
_FILLER = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua".split())
_QUOTING = re.compile(
    r"\b(?:wr[oi]te[sn]?|writing|type[sd]?|typing|call(?:s|ed)|named?|keeps?|path|variable|script|template|engine|syntax|placeholder|(?:on the|black)board|lesson|mail once|opened with|explain(?:s|ed)|example|code|field called|prints?|printed|swaps?|replaces?|typesetters?|printers|filled gaps|layout"
    r"|schrieb|schreibt|tippte|heißt|namens|platzhalter|vorlage|variable|erklärt\w*|beispiel|tafel|écri[tv]\w*|appel(?:le|é)\w*|nomm\w+|gabarit|modèle|exemple|tableau|escrib\w+|llam\w+|plantilla|ejemplo|pizarra)\b"
)
_QUOTES = "\"'“”„«»‘’`"
_ENDED = re.compile(r"[.!…][\"'»“”’)\]]*$")
_SPLIT = re.compile(r"(?<=[.!?…])\s+(?=\S)|(?<=[.!?…][\"'»“”’)\]])\s+(?=\S)")


def _hole(raw: str) -> int:
    """The weak label of a sentence with a placeholder or a printed missing value, -1 where it has none."""
    found = -1
    talk = bool(_QUOTING.search(fold(PLACEHOLDER.sub(" ", raw))))
    for hit in PLACEHOLDER.finditer(raw):
        before, after = raw[: hit.start()], raw[hit.end() :]
        quoted = before.rstrip()[-1:] in tuple(_QUOTES) or after[:1] in tuple(_QUOTES) or '"' in before[-14:] and '"' in after[:4]
        path = after[:1] in ("/", "\\") or before[-1:] in ("/", "=")
        code = hit.group()[0] == "{" and hit.group()[1] not in "{%" and (before[-1:] in tuple("})]=>") or after[:1] in tuple("{[(=;"))
        found = max(found, 0 if talk or quoted or path or code else 1)
    values = MISSING.findall(raw)
    if values:
        share = len(values) / max(1, len(raw.split()))
        code = any(c in raw for c in "{};=(|") and "[object" not in raw
        if code or talk or len(values) == 1 and values[0] in ("None", "null", "nil") and share < 0.08:
            found = max(found, 0)
        elif share >= 0.08 or len(values) >= 2:
            found = 1
    return found


def kind_of(raw: str) -> str:
    """What kind of pattern a sentence matches: hole, filler, dummy, notice, or '' for none."""
    low = fold(raw)
    words = re.findall(r"[^\W\d_]+", low)
    if PLACEHOLDER.search(raw) or MISSING.search(raw):
        return "hole"
    if len(words) >= 4 and sum(w in _FILLER for w in words) >= 0.3 * len(words):
        return "filler"
    if _DUMMY.search(low):
        return "dummy"
    return "notice" if (_PHRASES.search(low) or _STATUS.search(low)) and not _COMMENTS.search(low) else ""


def phrase_of(raw: str) -> str:
    """The words of a notice or dummy text that its pattern matched, '' for none; tells phrases apart when some are withheld."""
    low = fold(raw)
    hit = _DUMMY.search(low) or _PHRASES.search(low) or _STATUS.search(low)
    return hit.group() if hit else ""


def weak_label(raw: str, kind: str, size: int) -> int:
    """1, 0 or -1 (none) for a sentence of a kind, on a page of a size class beside such sentences."""
    hole = _hole(raw)
    if hole >= 0:
        return hole
    if kind == "filler":
        return 1
    if kind in ("dummy", "notice"):
        return 1 if size <= 1 else 0 if size == len(SIZES) else -1
    return 0


def weak_title(title: str, size: int) -> int:
    low = fold(tidy(title))
    if PLACEHOLDER.search(title) or low in ("", "undefined", "null", "nan", "[object object]"):
        return 1
    if not _STATUS.search(low):
        return 0
    return 1 if size <= 1 else 0 if size == len(SIZES) else -1


# --- what is judged -------------------------------------------------------------------


def size_class(blocks: list[Block]) -> int:
    """How much prose a page holds beside site furniture: 0 for next to none to `len(SIZES)`."""
    prose = 0
    for b in blocks:
        if b.mark != BAD:
            n = len(b.words)
            if n >= LONG_SENTENCE or n >= ENDED_SENTENCE and _ENDED.search(b.text):
                prose += n
    return sum(prose > s for s in SIZES)


def sentences(codes: list[int]) -> list[list[int]]:
    """Token hashes of a line cut at the ends of its sentences."""
    if END not in codes:
        return [codes]
    out, start = [], 0
    for k, c in enumerate(codes):
        if c == END:
            out.append(codes[start:k])
            start = k + 1
    return [*out, codes[start:]]


#: Signs that running prose seldom has, and the hash that stands for any word or number beside them.
_ODD = frozenset(codes_of(list("{}[]<>%$#@*|_/\\=~^`")))
_WORD = 0x51ED270B
_JOINS = frozenset(codes_of(list("._-")))
_PLAIN = frozenset(codes_of(list(".,;:!?…'\"“”„«»‘’()-–—&+·•"))) | {END}


def shapes(codes: list[int]) -> tuple[int, ...]:
    """Hashes of the distinct three neighbouring tokens of which two or more are odd signs; a run of words and joined words is one, whatever they say."""
    if _ODD.isdisjoint(codes):
        return ()
    kinds: list[int] = []
    for k, c in enumerate(codes):
        kind = c if c in _ODD or c in _PLAIN else _WORD
        if kind == _WORD:
            if kinds[-2:-1] == [_WORD] and kinds[-1] in _JOINS:
                kinds.pop()
            if kinds[-1:] == [_WORD]:
                continue
        kinds.append(kind)
    out = set()
    for k in range(len(kinds) - 1):
        three = kinds[k : k + 3]
        if sum(c in _ODD for c in three) >= 2:
            out.add((three[0] * 31 + three[1] * 1009 + (three[2] if len(three) > 2 else 7) * 65537) & 0xFFFFFFFF)
    return tuple(out) or (0x1B873593,)


def judged(title: str | None, blocks: list[Block]) -> tuple[list[list[int]], list[tuple[int, ...]]]:
    """Codes and signs of what is judged: the title first if there is one, then each sentence of each line."""
    size = size_class(blocks)
    codes, signs = [], []
    if title and title.strip():
        own = codes_of(tokens_of(fold(tidy(title))))
        codes.append([TITLE, *own])
        again = any(b.codes == own for b in blocks[:4])
        signs.append((200 + size, 210 + min(9, len(own).bit_length()), 220, 221 + again, 230 + size, *shapes(own)))
    for b in blocks:
        bad = b.mark == BAD
        for part in sentences(b.codes):
            codes.append(part)
            signs.append((240 + size, 250 + len(part).bit_length(), 260 + 10 * bad + size, *shapes(part)))
    return codes, signs


#: Stands before the tokens of a title, so that how it begins differs from how a sentence does.
TITLE = 0x7F4A7C15


def labelled(title: str | None, blocks: list[Block]) -> list[tuple[int, str]]:
    """(weak label, phrase that gave it) of each of `judged`. In a page with residue all over it, sentences no pattern knows have no label."""
    kinds = [[(raw, kind_of(raw)) for raw in _SPLIT.split(b.text)] for b in blocks]
    words = [len(raw.split()) for b, parts in zip(blocks, kinds) if b.mark != BAD and len(b.words) >= ENDED_SENTENCE for raw, kind in parts if not kind]
    size = sum(sum(words) > s for s in SIZES)
    out: list[tuple[int, str]] = []
    if title and title.strip():
        label = weak_title(title, size)
        out.append((label, "hole" if PLACEHOLDER.search(title) else phrase_of(tidy(title)) if label else ""))
    whole = any(y == 1 and p != "hole" for y, p in out)
    for b, parts in zip(blocks, kinds):
        if len(parts) != len(sentences(b.codes)):
            out += [(-1, "")] * len(sentences(b.codes))
            continue
        for raw, kind in parts:
            label = weak_label(raw, kind, size)
            out.append((label, phrase_of(raw) or kind if kind in ("dummy", "notice") else kind))
            whole = whole or label == 1 and (kind != "hole" or size == 0)
    return [(-1 if whole and y == 0 and not p else y, p) for y, p in out]


def are_residue(pages: list[tuple[str | None, list[Block]]], weights: np.ndarray) -> np.ndarray:
    """Whether the classifier takes the title or a sentence of each page for residue; a page without both is none."""
    codes, signs, owner = [], [], []
    for k, (title, blocks) in enumerate(pages):
        c, s = judged(title, blocks)
        codes += c
        signs += s
        owner += [k] * len(c)
    (scores,) = score(Stretches(codes, signs), weights)
    return np.bincount(np.array(owner, np.int64), scores > 0, minlength=len(pages)) > 0
