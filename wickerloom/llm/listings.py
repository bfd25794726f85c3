"""What a catalogue listing says about the product: series, number, generation, brand, maker's code and properties.

Statements are read in any wording and unit and brought to one form, so that two listings can be compared by value.
"""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

# Number words, colour words and units of measure with their size in the base unit.
NUMBER_WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split())}
COLOURS = {
    "black": "black", "jet black": "black", "blk": "black", "white": "white", "pure white": "white", "wht": "white", "gray": "grey", "grey": "grey", "gry": "grey",
    "silver": "silver", "silver-tone": "silver", "slv": "silver", "red": "red", "bright red": "red", "blue": "blue", "blu": "blue", "green": "green", "grn": "green",
    "beige": "beige", "bge": "beige", "yellow": "yellow", "orange": "orange", "purple": "purple", "pink": "pink", "brown": "brown", "gold": "gold",
}
UNITS = {
    "w": ("power", 1), "watt": ("power", 1), "watts": ("power", 1),
    "gb": ("storage", 1), "gigabyte": ("storage", 1), "gigabytes": ("storage", 1), "tb": ("storage", 1024), "terabyte": ("storage", 1024), "terabytes": ("storage", 1024),
    "mah": ("charge", 1), "ah": ("charge", 1000),
    "ml": ("volume", 1), "millilitre": ("volume", 1), "millilitres": ("volume", 1), "cl": ("volume", 10), "l": ("volume", 1000), "litre": ("volume", 1000), "litres": ("volume", 1000), "liter": ("volume", 1000), "liters": ("volume", 1000), "fl oz": ("volume", 29.5735), "fl. oz": ("volume", 29.5735), "fluid ounces": ("volume", 29.5735),
    "g": ("weight", 1), "gram": ("weight", 1), "grams": ("weight", 1), "kg": ("weight", 1000), "kilogram": ("weight", 1000), "kilograms": ("weight", 1000), "oz": ("weight", 28.3495), "ounce": ("weight", 28.3495), "ounces": ("weight", 28.3495), "lb": ("weight", 453.592), "lbs": ("weight", 453.592), "pounds": ("weight", 453.592),
    "mm": ("length", 0.1), "cm": ("length", 1), "m": ("length", 100), "metre": ("length", 100), "metres": ("length", 100), "meter": ("length", 100), "meters": ("length", 100), "ft": ("length", 30.48), "foot": ("length", 30.48), "feet": ("length", 30.48), "in": ("length", 2.54), "inch": ("length", 2.54), "inches": ("length", 2.54), '"': ("length", 2.54), "''": ("length", 2.54),
    "dpi": ("sensor", 1), "hz": ("refresh", 1), "hertz": ("refresh", 1), "port": ("ports", 1), "ports": ("ports", 1), "in-1": ("ports", 1),
}
RESOLUTIONS = {
    "720p": 720, "hd ready": 720, "1080p": 1080, "fhd": 1080, "full hd": 1080, "1920x1080": 1080, "1920 x 1080": 1080, "1440p": 1440, "qhd": 1440, "wqhd": 1440, "quad hd": 1440, "2560x1440": 1440, "2560 x 1440": 1440,
    "2160p": 2160, "uhd": 2160, "4k": 2160, "ultra hd": 2160, "3840x2160": 2160, "3840 x 2160": 2160,
}

#: Words that count pieces, words before a number of pieces, and words before a generation.
PIECES = {"pack", "packs", "pcs", "pc", "pieces", "piece", "count", "ct"}
PACKS = {"pack", "set", "box", "lot"}
GENERATIONS = {"gen", "generation", "mk", "mark", "version", "v"}
ROMAN = {"ii": 2, "iii": 3, "iv": 4}
#: Names of a property that may stand beside its value.
NAMES = {
    "power": {"power", "wattage", "output"}, "storage": {"storage", "capacity", "memory"}, "charge": {"charge", "battery", "capacity"}, "volume": {"volume", "capacity"}, "weight": {"weight"}, "length": {"length", "long", "screen", "size", "diagonal"},
    "sensor": {"sensor"}, "refresh": {"refresh"}, "ports": {"ports"}, "resolution": {"resolution", "display", "screen"}, "colour": {"colour", "color", "finish"}, "pack": {"pack", "quantity"}, "generation": {"generation", "version"},
}
#: Words before a number that states a standard and names no model.
STANDARDS = {"usb", "hdmi", "bluetooth", "wifi", "windows", "android", "ios", "class", "type", "cat", "ddr", "pcie", "level", "grade", "part", "no", "over", "under", "for", "with", "and", "the", "to", "up"}
NETWORKS = {"2g", "3g", "4g", "5g", "6g"}
#: Words after a model's number that make it another model, unless they are marketing in a catalogue.
VARIANTS = {"pro", "max", "plus", "mini", "ultra", "lite", "air", "se", "fe", "xl"}
#: Words before a maker's code and before a brand.
CODE_LABELS = {"mpn", "model", "reference", "ref", "sku", "part", "no", "number", "item"}
BRAND_LABELS = {("brand",), ("made", "by"), ("manufacturer",), ("maker",), ("manufactured", "by")}

#: Other words that a clause which states a value may hold.
CLAUSE_WORDS = 7

_SUFFIX = re.compile(r"(?:\s+(?:inc|ltd|llc|co|corp|gmbh)\.?)+$")


_CONTROL = re.compile("[\x00-\x08\x0e-\x1b\x7f]")


class _Kept(dict):
    """Code points to themselves, and to nothing those that leave no mark of their own; filled as they come."""

    def __missing__(self, code: int) -> int | None:
        c = chr(code)
        self[code] = kept = code if c.isascii() or unicodedata.category(c) not in ("Cf", "Mn", "Cc") else None
        return kept


_KEPT = _Kept()


def plain(text: str | None) -> str:
    """Lower case with entities, compatibility forms, marks without width and runs of white space resolved."""
    if not text:
        return ""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if text.isascii():
        return " ".join(_CONTROL.sub("", text).lower().split())
    text = unicodedata.normalize("NFKC", text.replace("™", "").replace("®", ""))
    text = _CONTROL.sub("", text.translate(_KEPT))
    return " ".join(text.lower().replace("‑", "-").replace("–", "-").replace("—", "-").replace("″", '"').replace("”", '"').split())


def letters(text: str) -> str:
    return re.sub(r"[^a-z]+", "", _SUFFIX.sub("", text.strip()))


def one_edit(a: str, b: str) -> bool:
    """Whether a and b are equal or one insertion, deletion, replacement or swap of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


_TOKEN = re.compile(r"\d+(?:[.,]\d+)*[^\W_]*|[^\W_]+|''|[^\w\s]")
_DIGITS = frozenset("0123456789")
_LED = re.compile(r"(\d+(?:[.,]\d+)*)(.*)", re.S)
_TRAILED = re.compile(r"([^\W\d_]+)(\d.*)", re.S)
_CAMEL = re.compile(r"\b((?:[A-Z][a-z]+){2,})[ -]?(\d+[A-Za-z]?)\b")


def _number(s: str) -> float:
    if s in NUMBER_WORDS:
        return NUMBER_WORDS[s]
    whole, _, rest = s.rpartition(",")
    # a comma before three digits parts thousands, else decimals
    s = s.replace(",", "") if not whole or len(rest.partition(".")[0]) == 3 else s.replace(",", ".")
    return float(s) if s.count(".") < 2 else 0.0


def _phrases() -> dict[str, list[tuple[tuple[str, ...], str, float | str]]]:
    """First token -> the colours, resolutions and other phrases that begin with it, longest first."""
    out: dict[str, list] = {}
    rows = [(k, "colour", v) for k, v in COLOURS.items()] + [(k, "resolution", float(v)) for k, v in RESOLUTIONS.items() if not k[0].isdigit()] + [("single pack", "pack", 1.0)]
    for text, kind, value in rows:
        tokens = tuple(_TOKEN.findall(text))
        out.setdefault(tokens[0], []).append((tokens, kind, value))
    for rows in out.values():
        rows.sort(key=lambda r: -len(r[0]))
    return out


_PHRASES = _phrases()
_HEIGHTS = {float(v) for v in RESOLUTIONS.values()}
#: Tokens with which a value may begin; all others are passed over at once.
_BEGINS = NUMBER_WORDS.keys() | _PHRASES.keys() | PACKS | GENERATIONS | ROMAN.keys()


def _numbered(tokens: list[str], i: int, digits: str, tail: str) -> tuple[int, str, float | str] | None:
    """The value that begins with a number at i, as (end, property, value); tail is what is joined to the number."""
    n, j = _number(digits), i + 1
    at = lambda k: tokens[k] if k < len(tokens) else ""
    if not tail:
        dashed = at(j) == "-"
        j += dashed
        tail = at(j)
        j += 1
        if not tail or (tail == "in" and not dashed and at(j)[:1].isalpha()):
            return None
    else:
        dashed = True
        if digits + tail in NETWORKS:
            return None
    if tail == "in" and at(j) == "-" and at(j + 1) == "1":
        return j + 2, "ports", n
    if tail == "fl":
        j += at(j) == "."
        return (j + 1, "volume", round(n * UNITS["fl oz"][1], 3)) if at(j) == "oz" else None
    if tail == "fluid":
        return (j + 1, "volume", round(n * UNITS["fl oz"][1], 3)) if at(j).startswith("ounce") else None
    if tail in UNITS:
        kind, size = UNITS[tail]
        return j, kind, round(n * size, 3)
    if tail in PIECES:
        return (j, "pack", n) if at(j) != "of" else None
    if tail == "p" and n in _HEIGHTS:
        return j, "resolution", n
    if tail == "k" and n == 4:
        return j, "resolution", 2160.0
    if tail[0] == "x":
        high = tail[1:] or at(j)
        if high[:1].isdigit() and high.isdigit() and float(high) in _HEIGHTS and n > float(high):
            return j + (tail == "x"), "resolution", float(high)
    if tail in ("st", "nd", "rd", "th") and at(j) in ("gen", "generation"):
        return j + 1, "generation", n
    return None


def _value_at(tokens: list[str], i: int) -> tuple[int, str, float | str] | None:
    t = tokens[i]
    if t[0].isdigit():
        m = _LED.match(t)
        return _numbered(tokens, i, m.group(1), m.group(2))
    if t in NUMBER_WORDS:
        return _numbered(tokens, i, t, "")
    for phrase, kind, value in _PHRASES.get(t, ()):
        if tuple(tokens[i : i + len(phrase)]) == phrase:
            return i + len(phrase), kind, value
    after = tokens[i + 1] if i + 1 < len(tokens) else ""
    if t in PACKS and after == "of" and i + 2 < len(tokens):
        n = tokens[i + 2]
        return (i + 3, "pack", _number(n)) if n in NUMBER_WORDS or n.isdigit() else None
    if t in GENERATIONS:
        j = i + 1 + (after == ".")
        n = tokens[j] if j < len(tokens) else ""
        return (j + 1, "generation", float(n)) if len(n) == 1 and n.isdigit() else None
    if t in ROMAN:
        return i + 1, "generation", float(ROMAN[t])
    return None


def _values(tokens: list[str]) -> list[tuple[int, int, str, float | str]]:
    """The values (start, end, property, value), none within another."""
    out, free = [], 0
    for i, t in enumerate(tokens):
        if (t in _BEGINS or t[0] in _DIGITS) and i >= free:
            found = _value_at(tokens, i)
        elif t[-1] in _DIGITS and i >= free and (m := _TRAILED.match(t)) and m.group(1) in GENERATIONS and len(m.group(2)) == 1:
            found = i + 1, "generation", float(m.group(2))
        else:
            continue
        if found:
            out.append((i, *found))
            free = found[0]
    return out


def _scan(tokens: list[str]) -> tuple[list[tuple[int, int, str, float | str]], list[str]]:
    """The values and the tokens with a ; in the place of each value."""
    values, rest, at = _values(tokens), [], 0
    for a, z, _, _ in values:
        rest += [*tokens[at:a], ";"]
        at = z
    return values, rest + tokens[at:]


@dataclass
class Listing:
    anchors: list[tuple[str, str]] = field(default_factory=list)
    code: str = ""
    brand: str = ""
    #: The brand with the word after it, should the name have been torn.
    longer: str = ""
    alias: str = ""
    words: list[str] = field(default_factory=list)
    properties: dict[str, float | str] = field(default_factory=dict)
    #: Words of VARIANTS right after a model's number, and all of them.
    variants: list[str] = field(default_factory=list)

    def add(self, kind: str, value: float | str) -> None:
        """A listing's first statement of a property counts."""
        self.properties.setdefault(kind, value)


def _code_at(tokens: list[str], i: int, labelled: bool) -> tuple[int, str] | None:
    """A maker's code at i, (end, code): letters, three digits or more, and letters, joined or parted by a mark; with a label, less will do."""
    t = tokens[i]
    if (m := _TRAILED.match(t)) and len(m.group(1)) <= 4 and sum(c in _DIGITS for c in t) >= 3:
        return i + 1, t
    if not t.isalpha() or len(t) > 3 or t in STANDARDS or t in COLOURS:
        return None
    j = i + 1
    j += j < len(tokens) and tokens[j] in "-/"
    n = tokens[j] if j < len(tokens) else ""
    if n[:1] in _DIGITS and n.isalnum() and sum(c in _DIGITS for c in n) >= 3 and (labelled or n[-1].isalpha() or not n.isdigit()) and not _value_at(tokens, j):
        return j + 1, t + n
    return None


def _take_code(tokens: list[str]) -> tuple[str, list[str]]:
    """The maker's code of a title and the tokens without it."""
    for i, t in enumerate(tokens):
        if t[0].isalpha() and (len(t) <= 3 or t[-1] in _DIGITS or t[-2:-1] in _DIGITS):
            labelled = i > 0 and (tokens[i - 1] in ("#", "(") or tokens[i - 1] in CODE_LABELS)
            if found := _code_at(tokens, i, labelled):
                return found[1], [*tokens[:i], ";", *tokens[found[0] :]]
    return "", tokens


def _said_code(tokens: list[str]) -> str:
    for i, t in enumerate(tokens):
        if t in CODE_LABELS:
            j = i + 1
            while j < len(tokens) and (tokens[j] in ":#(." or tokens[j] in CODE_LABELS):
                j += 1
            if j < len(tokens) and tokens[j][0].isalpha() and (found := _code_at(tokens, j, True)):
                return found[1]
    return ""


def _said_brand(tokens: list[str], most: int) -> tuple[str, str]:
    """The name after a brand's label, of `most` words at most, and with the next word; a dash within joins."""
    for label in BRAND_LABELS:
        for i, t in enumerate(tokens):
            if t == label[0] and tuple(tokens[i : i + len(label)]) == label:
                j = i + len(label)
                if len(label) == 1:
                    if j >= len(tokens) or tokens[j] != ":":
                        continue
                    j += 1
                words: list[str] = []
                while j < len(tokens) and len(words) <= most and (tokens[j].isalpha() or (tokens[j] == "-" and words)):
                    if tokens[j] == "-":
                        pass
                    elif words and tokens[j - 1] == "-":
                        words[-1] += tokens[j]
                    else:
                        words.append(tokens[j])
                    j += 1
                name = letters(" ".join(words[:most]))
                if len(name) > 3:
                    return name, letters(" ".join(words)) if len(words) > most else ""
    return "", ""


_ENDS = {".", "!", "?", ";", "\n"}
_CODED = re.compile(r"\d{3,}[a-z]{1,2}$|^[a-z]+\d{3,}")


def _ends(token: str) -> bool:
    """Whether a clause ends: at a mark, or at a maker's code, after which another begins."""
    return token in _ENDS or (token[-1] not in _DIGITS and token[0] in _DIGITS and bool(_CODED.search(token)) and _LED.match(token).group(2) not in UNITS)


def _states(tokens: list[str]) -> list[tuple[str, float | str]]:
    """(property, value) of the values that the clauses of a text state: at the end of a few words, or beside a name of the property.

    A bare value may be torn from its sentence, and one beside an x is a side of something; neither states anything.
    """
    out = []
    for a, z, kind, value in _values(tokens):
        left = right = 0
        k = a - 1
        while k >= 0 and not _ends(tokens[k]) and left <= CLAUSE_WORDS:
            left += tokens[k].isalnum()
            k -= 1
        k = z
        while k < len(tokens) and tokens[k] not in _ENDS and right <= CLAUSE_WORDS:
            right += tokens[k].isalnum()
            k += 1
        before = next((t for t in reversed(tokens[max(0, a - 2) : a]) if t.isalnum()), "")
        after = next((t for t in tokens[z : z + 2] if t.isalnum()), "")
        if before == "x" or after == "x":
            continue
        # a colon parts a value from what it is the value of
        parted = ":" in tokens[max(0, a - 2) : a] or ":" in tokens[z : z + 2]
        named = parted or after == "version" or before in NAMES[kind] or after in NAMES[kind]
        closing = right == 0 or (right == 1 and (kind != "colour" or after == "version"))
        if named or (closing and 1 <= left + right <= CLAUSE_WORDS):
            out.append((kind, value))
    return out


_CODE_LABEL = re.compile(r"\b(?:mpn|model|reference|ref|sku|part|no|number|item)\b")
_BRAND_LABEL = re.compile(r"brand|made by|manufacture|maker")
_SENTENCE = re.compile(r"(?<! fl\.)(?<=[.!?])\s+")


@lru_cache(maxsize=200_000)
def _read_text(text: str, most: int) -> tuple[tuple, str, tuple[str, str]]:
    """Statements, maker's code and brand of one sentence; sellers share most of theirs."""
    tokens = _TOKEN.findall(text)
    code = _said_code(tokens) if _CODE_LABEL.search(text) else ""
    brand = _said_brand(tokens, most) if _BRAND_LABEL.search(text) else ("", "")
    return tuple(_states(tokens)), code, brand


#: Characters of a text that is kept whole with what was read from it; longer ones are kept by sentence.
SHORT = 100


def _read_sentences(text: str, most: int) -> tuple:
    read = (_read_text(s, most) for s in _SENTENCE.split(plain(text)))
    return tuple(r for r in read if r != _NOTHING)


_NOTHING = ((), "", ("", ""))
_read_entry = lru_cache(maxsize=200_000)(_read_sentences)


def _vocabulary() -> dict[str, list[tuple[str, str]]]:
    """Forms with one letter left out -> (what it is, word) of units, number words and colours of some length."""
    out: dict[str, list] = {}
    words = [("unit", u) for u in UNITS if len(u) >= 4 and u.isalpha()] + [("number", w) for w in NUMBER_WORDS if len(w) > 3] + [("colour", c) for c in COLOURS if len(c) >= 5 and c.isalpha()]
    words += [("phrase", " ".join(p)) for rows in _PHRASES.values() for p, _, _ in rows if len(p) == 2 and all(x.isalpha() for x in p)]
    for kind, w in words:
        for form in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            out.setdefault(form, []).append((kind, w))
    return out


_NEAR = _vocabulary()
#: Letters of the longest word or phrase that is known.
LONGEST = max(len(w) for known in _NEAR.values() for _, w in known)


@lru_cache(maxsize=200_000)
def _near(word: str) -> dict[str, str] | None:
    """What the word misspells by one letter: units, number words, colours or phrases; titles share most of their words."""
    out: dict[str, str] = {}
    if len(word) > LONGEST + 1:
        return None
    for form in (word, *(word[:k] + word[k + 1 :] for k in range(len(word)))):
        for what, known in _NEAR.get(form, ()):
            if what not in out and one_edit(known, word):
                out[what] = known
    return out or None


_TWO = [p for rows in _PHRASES.values() for p, _, _ in rows if len(p) == 2]
_FIRST, _SECOND = {p[0] for p in _TWO}, {p[1] for p in _TWO}
#: Words of ordinary titles that lie one letter from a colour.
_NO_COLOUR = {"back", "block", "blank", "slack", "write", "while"}


def _add_misspelt(out: "Listing", rest: list[str]) -> None:
    """Measures, packs and colours of which one letter is wrong, where the property isn't stated otherwise."""
    words = [t for t in rest if t[0].isalnum()]
    near = [(_near(t) if len(t) > 2 else None) for t in words]
    for k, (a, b) in enumerate(zip(words, words[1:])):
        unit = (near[k + 1] or {}).get("unit") if len(b) >= 4 else None
        if a[0] in _DIGITS:
            if unit and (m := _LED.match(a)) and not m.group(2):
                out.add(UNITS[unit][0], round(_number(a) * UNITS[unit][1], 3))
            continue
        if (a in _FIRST or b in _SECOND) and len(a) + len(b) >= 7 and (p := (_near(f"{a} {b}") or {}).get("phrase")):
            _, kind, value = next(r for r in _PHRASES[p.split()[0]] if " ".join(r[0]) == p)
            out.add(kind, value)
        elif near[k] and (n := near[k].get("number")):
            if b in PIECES:
                out.add("pack", float(NUMBER_WORDS[n]))
            elif unit:
                out.add(UNITS[unit][0], float(NUMBER_WORDS[n] * UNITS[unit][1]))
    for t, n in zip(words, near):
        # number and unit written as one
        if t[0] in _DIGITS and len(t) > 4 and (m := _LED.match(t)) and len(m.group(2)) >= 4 and (u := (_near(m.group(2)) or {}).get("unit")):
            out.add(UNITS[u][0], round(_number(m.group(1)) * UNITS[u][1], 3))
    if "colour" not in out.properties:
        for w, n in zip(words, near):
            if n and 4 <= len(w) <= 7 and w not in _NO_COLOUR and (c := n.get("colour")):
                out.add("colour", COLOURS[c])
                break


def _anchors(rest: list[str]) -> tuple[list[tuple[str, str]], list[str]]:
    """(name, number) of every number that isn't a value, with the word before it, and the variant words after one."""
    out, variants = [], []
    for i, t in enumerate(rest):
        name = number = ""
        if t[0].isdigit():
            k = i - 1 - (i > 0 and rest[i - 1] == "-")
            if k >= 0 and rest[k].isalpha():
                name, number = rest[k], t
        elif not t.isalpha() and (m := _TRAILED.match(t)):
            name, number = m.groups()
            if len(name) < 2:  # S21
                k = i - 1 - (i > 0 and rest[i - 1] == "-")
                name, number = (rest[k] if k >= 0 and rest[k].isalpha() else ""), t
        after = rest[i + 1] if i + 1 < len(rest) else ""
        if name and name not in STANDARDS and number not in NETWORKS and len(number) <= 12 and after not in ("%", "+") and (len(after) < 4 or "unit" not in (_near(after) or ())):
            out.append((name, number.replace(",", "").replace(".", "_")))
            if after in VARIANTS:
                variants.append(after)
    return out, variants


def read_listing(title: str | None, features: list | None, description: str | None) -> Listing:
    """Everything the texts state; what they don't state stays empty."""
    out = Listing()
    tokens = _TOKEN.findall(plain(title))
    out.code, tokens = _take_code(tokens)
    values, rest = _scan(tokens)
    for _, _, kind, value in values:
        out.add(kind, value)
    out.anchors, out.variants = _anchors(rest)
    if title and (m := _CAMEL.search(title)):
        out.alias = "".join(c for c in m.group(1) if c.isupper()).lower() + " " + m.group(2).lower()
    if not out.anchors and out.code and (m := _TRAILED.match(out.code)):
        out.anchors = [m.groups()]
    out.words = [t for t in rest if t.isalpha()]
    out.words += [name for name, _ in out.anchors if name not in out.words]
    # an entry of the features and a sentence of a longer text are read alike
    texts = [(f, 3) for f in features or [] if f] + ([(description, 1)] if description else [])
    for text, most in texts:
        for stated, code, brand in _read_entry(text, most) if len(text) <= SHORT else _read_sentences(text, most):
            for kind, value in stated:
                out.add(kind, value)
            out.code = out.code or code
            if not out.brand:
                out.brand, out.longer = brand
    _add_misspelt(out, rest)
    return out


#: How far two measures may lie apart and still be one, for units that were converted and rounded.
TOLERANCE = 0.03


def same_value(a: float | str, b: float | str) -> bool:
    if isinstance(a, str) or isinstance(b, str):
        return a == b
    return abs(a - b) <= TOLERANCE * max(abs(a), abs(b))
