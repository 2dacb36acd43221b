"""Secret scans: fixed patterns, and strings that a dictionary-primed compressor finds novel in a sensitive context."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import map_batches

KINDS = ("assign", "access", "hex", "novel")
#: Characters on each side of a candidate that prime the compressor; share of its alphabet's entropy from which it is novel.
CONTEXT, NOVEL = 512, 0.9
#: Bits a character by which even chances must beat words: above what words in their texts reach, below random strings.
MARGIN = 0.4
#: Length of a candidate string, and how far behind a sensitive word it may begin.
LEAST, MOST, REACH = 16, 512, 24

# The base patterns, the words of a sensitive context, and identifiers that code is full of.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HINTS = ("passw", "secret", "token", "api")
_SENSITIVE = ("auth", "bearer", "credential", "private", "pwd", "passphrase", "signature", "access", "key", "secret", "token", "password", "session", "cookie")
_IDENTIFIERS = (
    "abstract access account action address append application argument array assert async attribute authorization await base64 basic bearer boolean break buffer button "
    "callback certificate character class client code column command comment component config connection console const content context continue cookie count create "
    "credential current data database default define delete description destination document domain double element else email encoding endpoint environment error event example "
    "exception execute export extends false field file filter final float folder format function global group handler hash header height host html http https identifier image "
    "implements import include index initialize input instance integer interface internal iterator javascript json key label language length library license list local localhost location "
    "login manager message metadata method model module name namespace network node null number object offset operator option order output package padding page parameter parent password path "
    "pattern payload permission pipeline placeholder pointer port position prefix primary print private process profile project property protected provider public query queue random read record "
    "redirect reference region register release remote remove render repository request require resource response result return role root route schema script secret security select self "
    "sequence server service session setting signature size source standard start state static status storage string struct style subscribe suffix switch symbol system table target template test "
    "text thread timeout timestamp title token transaction transform true type undefined unique unknown update upload user username utils value variable vector version view virtual void width window "
    "workspace write xmlns your_api_key changeme placeholder 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000-0000-0000-0000-000000000000"
)

# Common words of four languages, of which longer words are made.
_WORDS = (
    "about after again against also although always another answer around because become before begin behind being below between both bring brother build business called carry change children city close "
    "company could country course different during early earth every example family father few first follow found friend from general give going good government great group hand happen have head hear help here "
    "high history home house however human idea important information into just keep kind know large last later learn leave letter life light little long look made make many might money more morning most mother "
    "mountain move much must need never night nothing number often only other over paper part people perhaps place point possible power present problem question quite rather reason right river said school second "
    "several should since small social something sometimes stand still story study such take tell than that their them then there these they thing think this those though thought three through together toward under "
    "until very voice want water week well were what when where which while white with within without woman word work world would write year young management development understanding responsibility "
    "aber alle allein andere arbeit auch beispiel bereich besser bild bleiben brauchen bringen dann dass denken deutsch dieser doch durch eigen einfach einmal ende entwicklung ergebnis erste etwas familie finden "
    "frage frau freund ganz geben gegen gehen genau gesellschaft gesicht gestern gross grund haben hand haus heute hier immer jahr jetzt kein kind kommen konnte land lange lassen leben leicht letzte liegen machen "
    "mehr mensch minute mit mutter nacht nehmen nicht noch oder ohne recht richtig sagen schnell schon schreiben schule sehen sein selbst sicherheit sollte sprache stadt stehen stelle strasse stunde tag teil "
    "unter verbindung vergleich verschieden viel vielleicht wahrheit wasser weil weiter welche welt wenn werden wichtig wieder wirtschaft wissen woche wohnung wort zeit zeitung zukunft zusammen zwischen schaftlich keit lich ung heit "
    "ainsi aller alors amour annee apres aucun aujourd autre avant avec avoir beaucoup besoin bien bonne cause celui chaque chercher chose comme comment comprendre connaissance contre corps coup cours croire dans "
    "demander depuis dernier deux devant devenir devoir dire donner droit eau effet elle encore enfant ensemble entre entreprise esprit etat etre exemple faire famille femme fille fois force forme gouvernement grand "
    "guerre heure histoire homme idee jamais jeune jour laisser leur lieu long maison mais meilleur meme mettre moment monde mort mouvement nombre nouveau nuit parce parler partie passer pays pendant penser "
    "petit peuple place plus politique porter pour pouvoir premier prendre question quelque raison rendre rester rien sans savoir sembler sentir service seul siecle situation societe sous souvent suivre sujet "
    "temps tenir terre tete toujours tout travail trouver valeur venir vers vie ville visage vivre voir voix vouloir ement eaux ouse ieux "
    "ahora algo alguno antes aquel asunto aunque bajo bastante bien buscar cabeza cada calle cambio camino campo casa caso ciudad como conocer contra corazon cosa creer cuando cuenta cuerpo dar deber decir "
    "dejar dentro desarrollo desde despues dia dinero donde durante ella empezar encontrar entonces entrar escribir escuela ese espacio esperar estado estar fuerza gente gobierno grande guerra haber hablar hacer "
    "hasta hecho hermano hijo historia hombre hora idea importante lado largo libro llegar llevar lugar luz madre manera mano mayor medio mejor menos mientras mirar mismo momento mucho mujer mundo nada noche "
    "nombre nosotros nuevo nunca otro padre pagina palabra parecer parte pasar pensar pequeno perder persona poder poner porque primero problema pueblo punto quedar querer quien razon saber salir seguir siempre "
    "sistema sobre sociedad solo tambien tanto tener tiempo tierra tipo todo tomar trabajo tratar ultimo unidad usar valor vario venir verdad vida viejo vivir volver zona mente cion idad miento"
)

_SENSITIVE_WORD = re.compile("|".join(_SENSITIVE), re.I | re.A)
_WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,15}(?![A-Za-z0-9+/_=-])")
_ALPHABETS = [(n, re.compile(p)) for n, p in ((10, "[0-9]*"), (16, "[0-9a-f]*"), (16, "[0-9A-F]*"), (22, "[0-9A-Fa-f]*"), (26, "[a-z]*"), (26, "[A-Z]*"), (32, "[A-Z2-7]*"), (32, "[a-z2-7]*"), (36, "[a-z0-9]*"), (36, "[A-Z0-9]*"), (52, "[A-Za-z]*"))]
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each pattern that pass its length rule, as (start, end, kind)."""
    low = text.lower() if not text.islower() else text
    out = []
    if any(h in low for h in _HINTS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def _around(text: str, start: int, end: int) -> tuple[str, str]:
    """What stands on both sides of a string, without its other copies, whole ones across the limits too."""
    own, reach = text[start:end], CONTEXT + end - start
    before, after = text[max(0, start - reach) : start], text[end : end + reach]
    if own in before or own in after:
        return before.replace(own, " ")[-CONTEXT:], after.replace(own, " ")[:CONTEXT]
    return before[-CONTEXT:], after[:CONTEXT]


def novelty(candidate: str, before: str, after: str) -> float:
    """Compressed bytes that a candidate adds, a character, to a compressor primed with identifiers and what is around."""
    prime = zstandard.ZstdCompressionDict((_IDENTIFIERS + before + after).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    pack = zstandard.ZstdCompressor(level=3, dict_data=prime, write_content_size=False, write_checksum=False, write_dict_id=False)
    data = candidate.encode()
    return (len(pack.compress(data)) - len(pack.compress(b""))) / len(data)


def _alphabet(s: str) -> int:
    """Size of the smallest usual alphabet of a string's letters and digits, and each other character it holds."""
    body = "".join(c for c in s if c.isalnum())
    size = next((n for n, p in _ALPHABETS if p.fullmatch(body)), 62)
    return size + len(set(s) - set(body))


def _pairs(words: str) -> Counter[str]:
    """Counts of letters by the two before them, in words that begin and end with a space."""
    text = "  ".join(["", *words.lower().split(), ""])
    return Counter(text[k : k + n] for n in (1, 2, 3) for k in range(len(text) - n + 1))


def word_bits(candidate: str, around: str = "") -> float:
    """Bits of a candidate as words, paths and names are made: letters as in the dictionary and the words around."""
    near = _pairs(" ".join(_WORD.findall(around)))
    seen = lambda k: _LETTERS[k] + near[k]
    bits, past, last, capital = 0.0, "  ", "", True
    for c in candidate:
        if c.isalpha():
            if last == "" or not last.isalpha():
                bits += 1.0 + _FEW * last.isdigit()
                past, capital = "  ", c.isupper()
            elif c.isupper() == last.isupper():
                bits += _OFTEN
                capital = False
            elif c.islower() and capital:
                bits += 1.0
                capital = False
            else:
                bits += _FEW
                past, capital = "  ", c.isupper()
            low = c.lower()
            one = (seen(low) + 0.5) / (_TOTAL + 13)
            two = (seen(past[1] + low) + 4 * one) / (seen(past[1]) + 4)
            bits -= math.log2((seen(past + low) + 3 * two) / (seen(past) + 3))
            past = past[1] + low
        elif c.isdigit():
            bits += math.log2(10) + (0.5 if last.isdigit() else _FEW)
        else:
            bits += 1.0 + _FEW
        last = c
    return bits


def _is_words(candidate: str, around: str) -> bool:
    """Do words explain a candidate about as well as even chances over its alphabet, or better?"""
    return word_bits(candidate, around) <= len(candidate) * (math.log2(_alphabet(candidate)) + MARGIN)


_LETTERS = _pairs(_IDENTIFIERS.replace("abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ", "") + " " + _WORDS)
_TOTAL = sum(n for k, n in _LETTERS.items() if len(k) == 1)
#: Bits of what a word mostly goes on with, and of a change of case or of kind.
_OFTEN, _FEW = 0.3, 3.5


def novel_spans(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, float]]:
    """Strings of a sensitive context that the primed compressor can't shorten, outside the spans already taken.

    Every candidate is scored; those that are made of words, as paths and names are, go by `_is_words`.
    """
    out: list[tuple[int, int, float]] = []
    last = 0
    for m in _SENSITIVE_WORD.finditer(text):
        c = _CANDIDATE.search(text, max(m.end(), last), min(len(text), m.end() + REACH + MOST))
        if not c or c.start() > m.end() + REACH:
            continue
        c = _CANDIDATE.match(text, c.start())  # all of it, however long
        last = c.end()
        if any(s < c.end() and c.start() < e for s, e, _ in taken):
            continue
        before, after = _around(text, c.start(), c.end())
        n = novelty(c[0], before, after)
        if 8 * n >= NOVEL * math.log2(_alphabet(c[0])) and not _is_words(c[0], f"{before} {after}"):
            out.append((c.start(), c.end(), n))
    return out


def scan(text: str | None) -> list[dict]:
    """All spans of a whole text by start, then kind; offsets in code points, end exclusive; null: none."""
    text = text or ""
    base = base_spans(text)
    spans = [{"kind": k, "start": s, "end": e, "novelty": novelty(text[s:e], *_around(text, s, e))} for s, e, k in base]
    spans += [{"kind": "novel", "start": s, "end": e, "novelty": n} for s, e, n in novel_spans(text, base)]
    return sorted(spans, key=lambda x: (x["start"], KINDS.index(x["kind"]), x["end"]))


SPANS = "array<struct<kind:string,start:long,end:long,novelty:double>>"


def find_secrets(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, spans) per row, in one pass without a shuffle; rows don't depend on each other.

    Null and empty texts: no spans. Repeated rows: each its own. Long texts are scanned whole; the patterns
    take time in proportion to a text's length.
    """
    rows = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"id": b["id"], "spans": [scan(t) for t in b["text"].to_pylist()]}

    return map_batches(rows, run, f"id long, spans {SPANS}")


def redact(text: str, spans: list[dict], mark: str = "[SECRET]") -> str:
    """The text with each span, or run of overlapping spans, replaced."""
    out, last = [], 0
    for s in spans:
        if s["end"] <= last:
            continue
        if s["start"] >= last:
            out += [text[last : s["start"]], mark]
        last = s["end"]
    return "".join([*out, text[last:]])


def redact_secrets(documents: DataFrame) -> DataFrame:
    """documents with secrets replaced; n_chars follows a changed text; clean rows stay as they are."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            text, n = b["text"].to_pylist(), b["n_chars"].to_pylist()
            for k, t in enumerate(text):
                if t and (spans := scan(t)):
                    text[k] = redact(t, spans)
                    n[k] = len(text[k])
            yield b | {"text": text, "n_chars": n}

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))
    return map_batches(rows, run, "doc_id long, text string, lang string, source string, n_chars long")
