"""Texts that hold template residue, filler, error pages or script notices instead of content.

Labelled exemplars are kept in an inverted index from term to exemplar. Terms are the stems of words and, for template
syntax, the shape of a marked field. Windows over a text's passages retrieve the exemplars that share their rarer terms;
a window is covered where its TF-IDF weight is contained in one exemplar, or in the retrieved exemplars of a label
together. Document frequencies are those of the whole corpus, which also tells which words stand only beside filler and
which names stand in fields of unmistakable syntax. A text is excluded if a field is left in it, or if exemplars cover
most of its body's weight.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickerloom.session import spread

# Labelled exemplars.
FILLER = """
your text here
your content here
your description goes here
your headline title image here
text goes here
copy goes here
insert your text here
insert copy text image
add your description here
enter a product description
type something here
this is placeholder text
a placeholder for the content paragraph description
sample text
example text
dummy text
dummy content entry do not use or publish
for layout purposes only
replace this text with your own before publishing
to be replaced before publication
test test test #
testing testing
heading subheading body paragraph text block #
description coming soon
content coming soon
product information will be added shortly
more details will follow soon
details to follow
description to be added
body copy to follow
description pending
content pending
pending text
no description yet
to be determined
to be announced
under construction
tbd
tba
todo
n/a
xxx
blah blah blah
asdf asdf jkl
qwerty
foo bar baz
dies ist ein blindtext
hier steht ihr text
hier kommt die beschreibung
beschreibung folgt in kürze
text folgt
platzhalter für text inhalt bild
platzhaltertext
beispieltext
votre texte ici
insérez votre texte
la description sera ajoutée bientôt
description à venir
contenu à venir
texte de remplissage
texte provisoire
contenu provisoire
exemple de texte
su texto aquí
escriba su texto
inserte aquí el texto
aquí va la descripción
descripción pendiente
contenido pendiente
próximamente
texto de ejemplo
texto de relleno
testo segnaposto
inserisci qui il testo
descrizione in arrivo
testo di esempio
insira seu texto aqui
descrição em breve
texto de exemplo
voorbeeldtekst
uw tekst hier
beschrijving volgt
"""
ERROR = """
# not found
page not found
this page does not exist
this page doesn't exist
the page has gone missing or has moved
the page you requested could not be found
the requested url was not found on this server
we can't find that page
sorry we cannot find what you are looking for
nothing was found at this address
the link may be broken
oops
whoops
# error
http error #
error code #
an unexpected error has occurred code #
something went wrong on our end
# internal server error
the server encountered an unexpected condition
# bad gateway
# gateway timeout
# bad request
the server could not understand your request
invalid request
# forbidden
access denied
access to this resource is restricted
you are not authorised to view this page
you do not have permission to view this item
login required
please sign in again
please log in to continue
your session has expired
session timed out
# service unavailable
the service is temporarily unavailable
this page is currently not available
the site is down for maintenance
scheduled maintenance we will be back shortly
we are undergoing maintenance check back soon
# too many requests
rate limit exceeded slow down and retry
please try again later
try again in a few minutes
your request timed out
could not contact the upstream server
connection refused
connection timed out while waiting for the server
the connection failed
the database connection failed
error establishing a database connection
unable to load this page
failed to load content
this content could not be displayed
sorry this content is not available in your country region or area
this product is no longer available
this listing has been removed
verify you are human
confirm that you are not a robot
checking your browser before you continue
unusual traffic from your network
security check
traceback most recent call last
rendering the template failed at line #
fatal error uncaught exception
exception at line #
seite nicht gefunden
die angeforderte seite existiert nicht
zugriff verweigert
ihre sitzung ist abgelaufen
bitte melden sie sich erneut an
ein fehler ist aufgetreten
interner serverfehler
der dienst ist zurzeit nicht verfügbar
bitte versuchen sie es später erneut
page introuvable
la page demandée n'existe pas
accès refusé
votre session a expiré
une erreur est survenue
erreur interne du serveur
le service est momentanément indisponible
veuillez réessayer plus tard
página no encontrada
la página solicitada no existe
acceso denegado
su sesión ha caducado
se ha producido un error
error interno del servidor
el servicio no está disponible en este momento
inténtelo de nuevo más tarde
pagina non trovata
accesso negato
la sessione è scaduta
si è verificato un errore
il servizio non è al momento disponibile
riprova più tardi
página não encontrada
acesso negado
sua sessão expirou
ocorreu um erro
o serviço está indisponível no momento
tente novamente mais tarde
pagina niet gevonden
toegang geweigerd
uw sessie is verlopen
er is een fout opgetreden
de dienst is momenteel niet beschikbaar
probeer het later opnieuw
"""
SCRIPT = """
please enable javascript to view this page
please enable javascript in your browser settings
javascript is required
javascript is disabled in your browser
javascript is turned off
this site requires javascript and cookies
this shop needs scripts to work
this page cannot be shown without javascript
you must switch on js to see this content
you need to turn on scripts to use this app
activate javascript and reload
your browser does not support javascript
your browser does not run scripts so the product cannot be displayed
scripts are blocked
please allow scripts and reload the page
scripts are blocked you have to allow them to continue
check that scripting is allowed
if nothing happens
loading
loading please wait
noscript
interactive content is not available without scripts
the interactive catalogue needs scripts
we're sorry but this app doesn't work properly without javascript enabled
please enable it to continue
please enable cookies
please disable your ad blocker
turn off any ad blocker
ad blocker detected
javascript ist in ihrem browser deaktiviert
javascript est désactivé dans votre navigateur
javascript está desactivado en su navegador
javascript è disattivato nel tuo browser
o javascript está desativado no seu navegador
javascript is uitgeschakeld in uw browser
bitte aktivieren sie javascript um diese seite anzuzeigen
für diese seite wird javascript benötigt
ihr browser unterstützt kein javascript
ihr browser unterstützt keine skripte
veuillez activer javascript pour afficher cette page
javascript est nécessaire
votre navigateur ne gère pas les scripts
votre navigateur ne prend pas en charge javascript
active javascript para ver esta página
es necesario activar javascript
su navegador no admite scripts
su navegador no es compatible con javascript
attiva javascript per visualizzare questa pagina
il tuo browser non supporta javascript
ative o javascript para ver esta página
seu navegador não suporta javascript
schakel javascript in om deze pagina te bekijken
uw browser ondersteunt geen javascript
"""
#: What stands around or below a page's body: neither content nor residue.
FURNITURE = """
menu cart # sign in
home shop products about us
search our store
cookie settings
accept all cookies
back to homepage
go back contact us
all rights reserved
reference id #
skip to content
log in register
privacy policy
terms of use
please enable javascript to view the comments
error loading related products
more replies could not be loaded
sign in to see prices
"""
#: The classic filler prose, of which a passage may hold any words in any order; what stands only beside it is learned.
LOREM = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud
exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur
excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim est laborum
"""
#: Words of it that no language uses.
SEEDS = "lorem ipsum consectetur adipiscing eiusmod incididunt nostrud ullamco excepteur cupidatat"
#: Fields that templates leave, in the syntaxes of common template engines, mail merges and format strings.
FIELDS = """
{{name}} {{ first_name }} {{last_name}} {{full name}} {{email}} {{phone}} {{address}} {{city}} {{country}} {{company}} {{customer}} {{recipient}} {{sender}} {{user}} {{username}}
{{date}} {{time}} {{year}} {{month}} {{order}} {{invoice}} {{amount}} {{price}} {{total}} {{quantity}} {{currency}} {{product}} {{item}} {{title}} {{subject}} {{link}} {{url}} {{id}}
{{sku}} {{brand}} {{category}} {{model}} {{size}} {{color}} {{description}} {{feature}} {{rating}}
{{vorname}} {{nachname}} {{datum}} {{tage}} {{preis}} {{betrag}} {{kunde}} {{bestellung}} {{prénom}} {{nom}} {{prix}} {{montant}} {{jours}} {{client}} {{nombre}} {{apellido}} {{fecha}} {{precio}} {{días}} {{cliente}} {{pedido}} {{nome}} {{preço}} {{prezzo}}
{% if item %} <%= price %> <?php echo $title; ?> <!--#echo var=date --> ${total} #{user} $(product.name) $[price] {!amount} {0} {} %(name)s %s %1$s [[title]] *|NAME|* @@name@@ @Model.Title
[INSERT TITLE HERE] [gallery ids=] (your text here) [Your headline] ________ [object Object] #REF! #N/A insert-image-here
<<name>> <name> «name» [name] {name} %name% $name$ ~name~ __name__ [order_id] {order_id} %order_id% $order_id$ ~order_id~ __order_id__ <order_id> «order_id» <<order_id>> :order_id $order_id
It costs None USD, null, undefined, NaN, TODO, XXXX
"""
#: Followed by these, the word is language and no missing value.
NO_VALUE_CONTEXT = {
    "null": "modem pointer hypothesis and result set character byte terminator problem probleme problemo fehler komma device value",
    "undefined": "behaviour behavior term terms variable reference in at",
    "nan": "bread naan",
}


_NAME = r"[A-Za-z][A-Za-z0-9]*(?:[ _.\-][A-Za-z0-9]+)*(?:\[\d+\])?"
_TAG = re.compile(r"</?(?:a|abbr|article|b|blockquote|body|br|center|code|dd|div|dl|dt|em|font|footer|h[1-6]|head|header|hr|html|i|img|input|label|li|link|main|meta|nav|ol|option|p|pre|script|section|select|small|span|strong|style|sub|sup|table|tbody|td|tfoot|th|thead|title|tr|u|ul)(?:\s+[a-zA-Z\-:]+\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s<>\"']+))*\s*/?>", re.I)
#: Syntaxes that stand for a field whatever its name: shape, what a text with one holds in lower case, and pattern; the group of some is the name.
_SHAPES = [
    ("{{}}", "{{", r"\{\{([^{}\n]*)\}\}"), ("{%%}", "{%", r"\{%([^{}\n]*)%\}"), ("<%%>", "<%", r"<%=?([^%\n]*)%>"), ("<??>", "<?", r"<\?(?:php|=)[^?\n]*\?>"), ("<!--#-->", "<!--", r"<!--\s*#[^\n]*?-->"), ("${}", "${", r"\$\{([^{}\n]*)\}"),
    ("#{}", "#{", r"#\{([^{}\n]*)\}"), ("$()", "$(", r"\$\(([A-Za-z_][\w.]*)\)"), ("$[]", "$[", r"\$\[([A-Za-z_][\w.\[\]]*)\]"), ("{!}", "{!", r"\{!([A-Za-z_][\w.\[\]]*)\}"), ("{0}", "{", r"\{\d?\}"), ("%()s", "%(", r"%\(([A-Za-z_][\w.\[\]]*)\)[sdif]"),
    ("%s", "%", r"%(?<![\w%]%)(?:\d\$)?[sdif](?![\w%])"), ("[[]]", "[[", r"\[\[([A-Za-z_][^\[\]\n]*(?:\[\d+\])?)\]\]"), ("*||*", "*|", r"\*\|([A-Za-z_][^|\n]*)\|\*"), ("@@", "@@", r"@@([A-Za-z_][\w.\[\]]*)@@"), ("@Model", "@model", r"@(?<!\w@)Model\.\w+"),
    ("[insert]", "[insert", r"\[INSERT [^\n]+? HERE\]|\[INSERT [^\[\]\n]+\]"), ("[gallery]", "[gallery", r"\[gallery ids=[^\]]*\]"), ("(your)", "(your", r"\(your [A-Za-z_][\w.\[\]]* here\)"), ("___", "______", r"_{6,}"), ("[object]", "[object", r"\[object \w+\]"),
    ("#REF!", "#", r"#(?:REF!|N/A(?!\w)|VALUE!|NAME\?|DIV/0!|NULL!|NUM!)"), ("insert-image", "insert-image", r"(?<!\w)insert-image-here(?!\w)"), (":name", ":", r":(?<![\w:/]:)([a-z]+(?:_[a-z0-9]+)+)(?![\w:])"), ("$name", "$", r"\$(?<![\w$]\$)([a-z]+(?:_[a-z0-9]+)+)(?![\w$])"),
]
_SHAPES = [(shape, held, re.compile(p, re.I)) for shape, held, p in _SHAPES] + [("none", "none ", re.compile(r"(?<!\w)None(?= (?:USD|EUR|GBP|CHF|JPY|CNY|%)(?!\w))"))]
#: Syntaxes that also stand in ordinary text; they are a field's by its name or the name's form.
_BRACKETS = [(a + z + ":", a, re.compile(re.escape(a) + f"({_NAME})" + re.escape(z))) for a, z in (("<<", ">>"), ("<", ">"), ("«", "»"), ("[", "]"), ("{", "}"), ("%", "%"), ("$", "$"), ("~", "~"))]
_BRACKETS.append(("____:", "__", re.compile(r"__([A-Za-z][A-Za-z0-9.\[\]]*(?:_[A-Za-z0-9.\[\]]+)*)__")))
#: Names in a form that ordinary words don't have: order_id, ORDER_ID, orderId, orderID, OrderId, item.title, item[0]. A short first part is a trade name's (iPhone, eBay).
_NAME_FORM = re.compile(r"[A-Za-z][A-Za-z0-9]*(?:[_.][A-Za-z0-9]+)+(?:\[\d+\])?|[A-Za-z]+\[\d+\]|[a-z]{2,}[a-z0-9]*(?:[A-Z][a-z]+[0-9]*)+(?:ID)?|[A-Za-z][a-z]+(?:[A-Z][a-z]+)*I[dD]")
_PRINTED = re.compile(r"(?<![\w/.-])(null|undefined|nan|TODO|[Xx]{4,})(?![\w/-])", re.I)
_SPANISH = re.compile(r"(?<!\w)(?:el|la|los|las|de|del|que|por|para|con|en|es|un|una)(?!\w)", re.I)
_INVISIBLE = re.compile("[\x00-\x08\x0b-\x1f\x7f-\x9f\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff\ufff9-\ufffb]")
_TERM = re.compile(r"n0a(?!\w)|[^\W\d_]+(?:['’][^\W\d_]+)*|\d[\w-]*")
_PASSAGE = re.compile(r"\n+|(?<=[.!?…])\s+|(?<=[.!?…]['\")\]])\s+")

LABELS = ("template", "filler", "error", "script")
#: Share of the weight that makes a match, and share of the body's weight that makes a case.
MATCH, COVERED = 0.75, 0.7
#: Share of a window's weight in the retrieved exemplars of a label together that makes the whole window a match.
TOGETHER = 0.65
#: Weight of the terms that retrieve an exemplar, as a share of its heaviest.
RETRIEVING = 0.5
#: Terms of a window over a passage, and how far the next one begins after it.
WINDOW, STEP = 16, 8
#: Letters of a word that make its stem.
STEM = 6
#: Slots of the counts; terms share a slot by hash, so the tables are the same size for any corpus.
SLOTS = 1 << 18
#: Share of a word's documents that hold filler prose from which the word is filler too.
BESIDE = 0.5


def slot(term: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(term) % SLOTS


def plain_name(name: str) -> str:
    """A field's name without separators, index and case."""
    return re.sub(r"[^a-z]", "", re.sub(r"\[\d+\]$", "", name).lower())


def _marks(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, shape, name) of what may be fields; shapes of brackets that also stand in ordinary text end in a colon."""
    low = text.lower()
    out = []
    for shape, held, pattern in _SHAPES:
        if held in low:
            out += [(*m.span(), shape, (m.group(1) or "") if pattern.groups else "") for m in pattern.finditer(text)]
    for shape, held, pattern in _BRACKETS:
        if held in low:
            out += [(*m.span(), shape, m.group(1)) for m in pattern.finditer(text)]
    return out


def _shape(text: str, mark: tuple[int, int, str, str], known) -> str:
    """The term of a mark: for brackets of ordinary text with the way in which the name is a field's, if it is one."""
    a, z, shape, name = mark
    if not shape.endswith(":"):
        return shape
    if shape == "<>:" and (_TAG.fullmatch(text, a, z) or name.lower() in ("first", "last")):
        return shape
    words = name.split()
    if len(name) >= 3 and (known(plain_name(name)) or (words[0].lower() in ("your", "insert", "enter") and len(words) > 1)):
        return shape + "field"
    # by form alone, an index (row[max_len]), a part of a word and a link's text are no fields
    apart = not re.match(r"\w", text[z : z + 1]) and not re.search(r"\w$", text[max(0, a - 1) : a]) and not text.startswith("](", z - 1)
    return shape + "field" if apart and _NAME_FORM.fullmatch(name) else shape


def _printed(text: str) -> list[tuple[int, int, str]]:
    """(start, end, term) of values that a template printed for want of one."""
    found = []
    low = text.lower()
    if not any(w in low for w in ("null", "undefined", "nan", "todo", "xxxx")) or not _PRINTED.search(text):
        return found
    cased = re.sub(r"[^A-Za-z]", "", text)
    one_case = cased.isupper() or cased.islower()
    for m in _PRINTED.finditer(text):
        w = m.group(1)
        after = re.match(r"\s+([^\W\d_]+)", text[m.end() :])
        if after and after.group(1).lower() in NO_VALUE_CONTEXT.get(w.lower(), "").split():
            continue
        # an acronym or a foreign word is told by its case: NaN, TODO and XXXX; a text in one case has lost it
        if w.lower() == "nan" and w != "NaN" and not one_case:
            continue
        if w.lower() == "todo" and (w != "TODO" or one_case) and not (one_case and not _SPANISH.search(text) and not (after and after.group(1).lower() in ("list", "app", "lists"))):
            continue
        if w.lower().startswith("x") and not (w.isupper() or one_case):
            continue
        found.append((*m.span(), "xxxx" if w.lower().startswith("x") else w.lower()))
    return found


def field_terms(text: str, known) -> list[tuple[int, int, str]]:
    """(start, end, term) of every mark and printed value, in order."""
    return sorted([(m[0], m[1], _shape(text, m, known)) for m in _marks(text)] + _printed(text))


@lru_cache(maxsize=1)
def _field_exemplars() -> tuple[frozenset[str], frozenset[str]]:
    """The names that stand in exemplar fields of unmistakable syntax, and the terms of all exemplar fields."""
    names = frozenset(plain_name(n) for line in FIELDS.splitlines() for *_, shape, n in _marks(line) if n and not shape.endswith(":"))
    return names, frozenset(t for line in FIELDS.splitlines() for *_, t in field_terms(line, names.__contains__) if not t.endswith(":"))


def fields(text: str, known=None) -> list[tuple[int, int]]:
    """Offsets of the unfilled fields and of values that a template printed for want of one: the marks whose terms are in the index.

    known: tells names of fields beside those of the exemplars.
    """
    names, index = _field_exemplars()
    return [(a, z) for a, z, t in field_terms(text, lambda n: n in names or (known is not None and known(n))) if t in index]


def prepare(text: str) -> str:
    """Entities, compatibility forms and marks of no width resolved; markup removed; breaks kept."""
    t = html.unescape(text)
    t = unicodedata.normalize("NFKC", t)
    t = _INVISIBLE.sub("", t)
    if "<" not in t:
        return t
    return _TAG.sub(lambda m: "\n" if re.match(r"</?(?:p|br|div|li|h\d|tr|ul|ol|table|section)", m.group(), re.I) else " ", t)


class _Memo(dict):
    """A function's values by argument, forgotten when they are many; a lookup costs no call."""

    def __init__(self, f) -> None:
        self.f = f

    def __missing__(self, x):
        if len(self) > 500_000:
            self.clear()
        self[x] = value = self.f(x)
        return value


def _stem(word: str) -> str:
    word = word.strip("'")
    return "n/a" if word == _NA else "#" if word[:1].isdigit() else word[:STEM]


_STEMS = _Memo(_stem)
#: n/a is one word.
_NA = "n0a"
_APART = str.maketrans({c: " " for c in map(chr, range(128)) if not (c.isalnum() or c == "'")})


def terms(passage: str) -> list[str]:
    """Stems of the words; # stands for any number."""
    low = passage.lower()
    if "n/a" in low:
        low = re.sub(r"(?<!\w)n/a(?!\w)", _NA, low)
    words = low.translate(_APART).split() if low.isascii() else _TERM.findall(low.replace("’", "'"))
    return [*filter(None, map(_STEMS.__getitem__, words))]


class Exemplars:
    """The labelled exemplars and their inverted index under given document frequencies."""

    def __init__(self, counts: dict[int, tuple[int, int]], documents: int) -> None:
        self.counts, self.documents = counts, max(1, documents)
        self.items: list[tuple[str, dict[str, float]]] = []
        self.postings: dict[str, list[int]] = defaultdict(list)
        for label, block in (("filler", FILLER), ("error", ERROR), ("script", SCRIPT), ("furniture", FURNITURE)):
            for line in block.strip().splitlines():
                # of a phrase that repeats one term, one is enough
                self.items.append((label, {t: self._idf(t) for t in terms(line.replace("#", "0"))}))
        for k, (_, vector) in enumerate(self.items):
            # a window retrieves an exemplar by any of its terms but the light ones
            for t, w in vector.items():
                if w >= RETRIEVING * max(vector.values()):
                    self.postings[t].append(k)
        self.lorem = frozenset(terms(LOREM))
        self.vocabulary = frozenset(t for _, v in self.items for t in v)
        names, self.field_index = _field_exemplars()
        self.idf, self.is_prose = _Memo(self._idf).__getitem__, _Memo(self._is_prose).__getitem__
        self.known = lambda n: n in names or self.counts.get(SLOTS + slot(n), (0, 0))[0] > 1

    def _idf(self, term: str) -> float:
        return 1.0 + math.log((1 + self.documents) / (1 + self.counts.get(slot(term), (0, 0))[0]))

    def _is_prose(self, term: str) -> bool:
        """Whether the word is classic filler, or stands mostly in documents that hold it."""
        n, beside = self.counts.get(slot(term), (0, 0))
        return term in self.lorem or (beside > 1 and beside >= BESIDE * n)

    def may_match(self, words: list[str]) -> bool:
        """Whether so many words are exemplars' or filler that these can be most of the body; titles of some words may stand around it."""
        known = sum(map(self.vocabulary.__contains__, words))
        if len(words) - known <= known + 24:
            return True
        return sum(map(self.is_prose, words)) >= 3 and 2 * sum(t in self.vocabulary or self.is_prose(t) for t in words) + 24 >= len(words)

    def cover(self, window: list[str]) -> dict[int, str]:
        """Place of a covered term in the window -> label of the exemplars that cover it."""
        there = set(window)
        near = {k for t in there for k in self.postings.get(t, ())}
        out: dict[int, str] = {}
        if near:
            scores = {k: sum(w for t, w in self.items[k][1].items() if t in there) for k in near}
            whole = sum(self.idf(t) for t in there)
            for k, shared in sorted(scores.items(), key=lambda x: (-x[1], x[0])):
                label, vector = self.items[k]
                size = sum(vector.values())
                # the exemplar stands in the window, or the window is most of what the exemplar says
                if shared >= MATCH * size or (shared >= MATCH * whole and shared >= 0.5 * size):
                    for place, t in enumerate(window):
                        if t in vector:
                            out.setdefault(place, label)
            # other wordings: the window's weight lies in the retrieved exemplars of a label together
            for label in ("filler", "error", "script"):
                union = {t for k in near if self.items[k][0] == label for t in self.items[k][1]}
                if sum(self.idf(t) for t in there & union) >= TOGETHER * whole:
                    for place in range(len(window)):
                        out.setdefault(place, label)
        prose = sum(map(self.is_prose, window))
        if prose >= max(3, MATCH * len(window)):
            out = dict.fromkeys(range(len(window)), "filler")
        return out

    def cover_passage(self, words: list[str]) -> dict[int, str]:
        """cover of the whole passage, and of windows of a long one."""
        out = self.cover(words)
        if len(words) > WINDOW:
            for a in range(0, len(words) - STEP, STEP):
                for place, label in self.cover(words[a : a + WINDOW]).items():
                    out.setdefault(a + place, label)
        return out


_TITLE = re.compile(r"^(?:title|product|item|page)\s*:", re.I)


def judge(text: str | None, exemplars: Exemplars) -> tuple[str | None, float | None, str | None]:
    """(label or None, covered share of the body, evidence); the share is None where a clean text was known before its end."""
    if not text or not text.strip():
        return None, 0.0, None
    raw = html.unescape(text) if "&" in text else text
    # each mark is a window of its own, which the index covers or not
    for a, z, term in field_terms(raw, exemplars.known):
        if term in exemplars.field_index:
            return "template", 1.0, raw[a:z]
    plain = prepare(text)
    every = terms(plain)
    if not exemplars.may_match(every):
        return None, 0.0, None
    idf = exemplars.idf
    # beyond this weight of uncovered body no cover of the rest makes a case
    most = (1 - COVERED) * sum(map(idf, every))
    weights: dict[str, float] = defaultdict(float)
    body, uncovered, evidence, titles = 0.0, 0.0, None, 0
    for line in plain.split("\n"):
        line = line.strip()
        for passage in _PASSAGE.split(line) if line else ():
            words = terms(passage)
            covered = exemplars.cover_passage(words)
            total = sum(map(idf, words))
            by: dict[str, float] = defaultdict(float)
            for p, label in covered.items():
                by[label] += idf(words[p])
            residue = [label for label in by if label != "furniture"]
            if by["furniture"] >= 0.6 * total:
                continue
            if not residue:
                crumbs = line.count(">") >= 2 and len(words) <= 12
                # a page's title: a few words without a sentence's end
                title = _TITLE.match(line) or (len(words) <= 5 and not re.search(r"[.!?,;]", line))
                if (crumbs or title) and titles < 3:
                    titles += 1
                    continue
            body += total
            for label, w in by.items():
                weights[label] += w
            uncovered += total - sum(by[label] for label in residue)
            if uncovered > most + 1e-9:
                return None, None, None
            if evidence is None and residue:
                evidence = passage
    found = {k: w for k, w in weights.items() if k != "furniture"}
    share = sum(found.values()) / body if body else 0.0
    if share >= COVERED:
        return max(sorted(found), key=lambda k: found[k]), share, evidence
    return None, share, None


def corpus_counts(documents: DataFrame, text: str = "text") -> tuple[dict[int, tuple[int, int]], int]:
    """Slot -> (documents, documents that hold filler prose too) over all documents, and the number of documents.

    Slots below SLOTS are of terms, those from SLOTS on of names in fields whose syntax is unmistakable or curly.
    """
    seeds = frozenset(terms(SEEDS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Memo(slot)
        n, beside, docs = np.zeros(2 * SLOTS + 1, np.int64), np.zeros(2 * SLOTS + 1, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                docs += 1
                if not t:
                    continue
                words = set(terms(t))
                at = [*{*map(slots.__getitem__, words)}]
                n[at] += 1
                if words & seeds:
                    beside[at] += 1
                names = {plain_name(name) for *_, shape, name in _marks(t) if name and (not shape.endswith(":") or shape == "{}:")}
                if names:
                    n[[SLOTS + slot(x) for x in names if x]] += 1
        n[2 * SLOTS] = docs
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(beside[some])], ["slot", "n", "beside"])

    rows = spread(documents.select(text)).mapInArrow(count, "slot int, n long, beside long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("beside").alias("beside")).toArrow()
    table = {s: (n, b) for s, n, b in zip(*(c.to_pylist() for c in rows.columns))}
    return table, table.pop(2 * SLOTS, (0, 0))[0]


def find_residue(documents: DataFrame, item: str = "doc_id", text: str = "text") -> DataFrame:
    """(item, label, coverage, evidence) of every document; label is null for a clean one, coverage where so much of it was uncovered that the rest didn't matter.

    label: template (an unfilled field, or a value printed for want of one, anywhere), filler, error or script (the
    body, without page titles and menus, is of that kind). A text that speaks of such things or ends in such a notice
    is clean, and so is one that is null or blank. Whole texts are read and frequencies counted over all documents;
    repeated rows are judged alike. An empty table gives no rows.
    """
    counts, n = corpus_counts(documents, text)
    shared = documents.sparkSession.sparkContext.broadcast((counts, n))
    kind = documents.schema[item]
    schema = T.StructType([kind, T.StructField("label", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("evidence", T.StringType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exemplars = Exemplars(*shared.value)
        for b in batches:
            got = [judge(t, exemplars) for t in b.column(1).to_pylist()]
            columns = [*zip(*got)] or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.string())], [item, "label", "coverage", "evidence"])

    return spread(documents.select(item, text)).mapInArrow(label, schema)
