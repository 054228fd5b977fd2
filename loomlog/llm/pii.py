"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust a score.

Every kind is found in one left-to-right pass whose work is linear in the text, also where a text is one long run of
digits or letters (a plain search would restart within the run).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import numbered, picked, place_of, small_batches, steps

#: The kinds whose spans are fixed by the contract, in order, then those that the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "ssn", "nir", "dni", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_NIR = re.compile(r"(?<![0-9A-Za-z])[12]\x20?[0-9]{2}\x20?[0-9]{2}\x20?(?:[0-9]{2}|2[AB])\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{2}(?![0-9A-Za-z])")
_DNI = re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{8}|[XYZ]-?[0-9]{7})-?[A-Z](?![0-9A-Za-z])")
#: A value behind its name; key is the value.
_NAMED = re.compile(r"(?<![A-Za-z0-9_])(?:[A-Za-z0-9_-]{0,20}[_-])?(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|passwort|kennwort|schl[\u00fcu]ssel|mot[ _]de[ _]passe|jeton|contrase[\u00f1n]a|clave)[\"']?\s{0,3}(?:[:=]|=>)\s{0,3}[\"']?([A-Za-z0-9+/_.$!@-]{16,}=?=?)", re.I)
#: Keys that have a shape of their own, by their public prefixes.
_SHAPED = re.compile(
    r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}|\bgithub_pat_[A-Za-z0-9_]{22,}|\bglpat-[A-Za-z0-9_-]{20,}|\bxox[abposr]-[A-Za-z0-9-]{10,}|\bAIza[A-Za-z0-9_-]{35}"
    r"|\bsk-[A-Za-z0-9_-]{20,}|\b[sr]k_live_[A-Za-z0-9]{16,}|\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]++-----END [A-Z ]{0,30}PRIVATE KEY-----"
)
_SHAPES_HINT = re.compile(r"AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abposr]-|AIza|sk-|k_live_|eyJ|-----BEGIN")

#: Cheap tests for what every span of a kind holds.
_DIGIT, _IP_HINT, _IBAN_HINT, _SSN_HINT, _LONG_HINT = map(re.compile, (r"[0-9]", r"[0-9]\.[0-9]", r"[A-Z][A-Z][0-9][0-9]", r"[0-9]-[0-9][0-9]-[0-9]", r"[0-9]{7}|[0-9] [0-9]{2} [0-9]"))

#: The score of a kind before its context is read, and words (or beginnings of words, with a hyphen after them)
#: that raise or lower it, in English, German, French and Spanish.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "nir": 0.6, "dni": 0.4, "secret": 0.8}
RAISES = {
    "email": "mail- e-mail- email- contact- write kontakt- schreib- courriel- contacte- correo- escrib- envoy-",
    "ip": "ip address- host- server- adress- rechner- serveur- h\u00f4te- direcci\u00f3n servidor-",
    "card": "card- visa mastercard credit- payment- kredit- karte- zahlung- carte- paiement- cr\u00e9dit tarjeta- pago-",
    "phone": "phone- tel telephone- call- mobile- fax telefon- ruf- anruf- handy- mobil- t\u00e9l t\u00e9l\u00e9phone- appel- portable- tel\u00e9fono- llam- m\u00f3vil-",
    "iban": "iban bank- account- konto- \u00fcberweis- compte- banque- virement- cuenta- banco- transfer-",
    "ssn": "ssn social security",
    "nir": "s\u00e9curit\u00e9 sociale nir insee assur\u00e9- immatricul-",
    "dni": "dni nie nif identidad identificaci\u00f3n",
    "secret": "key- auth- login- schl\u00fcssel- anmeld- cl\u00e9- connexion- clave- acceso-",
}
LOWERS = {
    "email": "example- beispiel- exemple- ejemplo-",
    "ip": "version- release- kapitel- chapter- section- chapitre- versi\u00f3n cap\u00edtulo-",
    "card": "order- isbn serial- bestell- serien- commande- s\u00e9rie- pedido- serie-",
    "phone": "ratio- score- ergebnis- r\u00e9sultat- resultado-",
    "iban": "sample- example- muster- beispiel- exemple- ejemplo-",
    "ssn": "part- serial- teil- pi\u00e8ce- pieza-",
    "nir": "s\u00e9rie- serial- commande-",
    "dni": "serial- serie- pedido- order-",
    "secret": "placeholder- example- beispiel- exemple- ejemplo-",
}
#: Characters read on either side of a span for its context, the step a context word moves the score by, and the least score.
CONTEXT, STEP, LEAST = 48, 0.2, 0.5


def _any_of(words: str) -> re.Pattern:
    """The words, as whole words or as beginnings of words."""
    return re.compile(r"(?<!\w)(?:" + "|".join(re.escape(w[:-1]) if w.endswith("-") else re.escape(w) + r"(?!\w)" for w in words.split()) + ")")


_RAISES, _LOWERS = ({kind: _any_of(words) for kind, words in table.items()} for table in (RAISES, LOWERS))


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if place % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    compact = iban.replace(" ", "")
    if not 15 <= len(compact) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def nir_key(number: str) -> bool:
    """The French social-security number's last two digits complete its first thirteen to a multiple of 97."""
    compact = number.replace(" ", "")
    body = int(compact[:13].replace("2A", "19").replace("2B", "18"))
    return int(compact[13:]) == 97 - body % 97


def dni_letter(number: str) -> bool:
    """The Spanish identity number's letter by its remainder after division by 23."""
    compact = number.replace("-", "")
    head = compact[:-1].translate(str.maketrans("XYZ", "012"))
    return compact[-1] == "TRWAGMYFPDXBNJZSQVHLCKE"[int(head) % 23]  # fixed values


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans, by kind as listed, then start."""
    spans = [("email", *s) for s in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return spans
    if _IP_HINT.search(text):
        spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return spans


def more_spans(text: str) -> list[tuple[str, int, int]]:
    """Further kinds, by kind as listed, then start: checksums confirm an IBAN, a NIR and a DNI, context has to speak for a DNI
    and a social-security number, secrets follow their name or have a shape of their own."""
    spans = [("iban", *m.span()) for m in _IBAN.finditer(text) if mod97(m[0])] if _IBAN_HINT.search(text) else []
    spans += [("ssn", *m.span()) for m in _SSN.finditer(text)] if _SSN_HINT.search(text) else []
    if _LONG_HINT.search(text):
        spans += [("nir", *m.span()) for m in _NIR.finditer(text) if nir_key(m[0])]
        spans += [("dni", *m.span()) for m in _DNI.finditer(text) if dni_letter(m[0])]
    named = {m.span(1) for m in _NAMED.finditer(text)} if "=" in text or ":" in text else set()
    shaped = {m.span() for m in _SHAPED.finditer(text)} if _SHAPES_HINT.search(text) else set()
    spans += [("secret", *s) for s in sorted(named | shaped)]
    return [s for s in spans if score(text, *s) >= LEAST]


def score(text: str, kind: str, start: int, end: int) -> float:
    """How likely the span is personal data: its kind's prior, moved by words near it; 0 to 1."""
    near = (text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]).lower()
    moved = PRIOR[kind] + STEP * bool(_RAISES[kind].search(near)) - STEP * bool(_LOWERS[kind].search(near))
    return round(min(1.0, max(0.0, moved)), 3)


def find(text: str) -> list[tuple[str, int, int]]:
    return base_spans(text) + more_spans(text)


def redact(text: str) -> str:
    """text with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    merged: list[list] = []
    for kind, start, end in sorted(find(text), key=lambda s: (s[1], -s[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    if not merged:
        return text
    parts, at = [], 0
    for kind, start, end in merged:
        parts += [text[at:start], f"<{kind}>"]
        at = end
    return "".join([*parts, text[at:]])


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


DIGEST = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_more long, scores string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        rows: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "n_more", "scores")}
        for text in batch.column("text"):
            text = text.as_py() or ""
            base = base_spans(text)
            spans = base + more_spans(text)
            for kind in BASE_KINDS:
                rows[f"n_{kind}"].append(sum(s[0] == kind for s in base))
            rows["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            rows["spans"].append(_joined(spans))
            rows["n_spans"].append(len(spans))
            rows["n_more"].append(len(spans) - len(base))
            rows["scores"].append(",".join(f"{score(text, *s):g}" for s in spans))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)]], ["doc_id", *rows])


def pii_spans(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: counts and digest of the base spans, all spans, how many there are (n_more: beyond the base ones)
    and their scores.

    Null and empty texts have no spans. Repeated rows, also of one id, are read each. A null id stays null. An empty table gives
    no rows. Only the columns named exactly id and text count, whatever other columns there are. Texts are read whole.
    """
    return picked(docs, doc_id=id, text=text).mapInArrow(_digest, DIGEST)


def _redactor(column: str):
    def redacted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, column):
            new = [None if (t := x.as_py()) is None else redact(t) for x in batch.column(column)]
            yield batch.set_column(batch.schema.get_field_index(column), column, pa.array(new, pa.string()))

    return redacted_rows


def redacted(docs: DataFrame, text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """docs, same columns and rows, with personal data in the text replaced by its kind; null stays null.

    A column of the name size (if there is one) gets the new text's length in characters.
    """
    names, at = docs.columns, place_of(docs, text)
    given = numbered(docs)
    small_batches(docs.sparkSession)
    schema = StructType([StructField(f.name, StringType() if f.name == at else f.dataType) for f in given.schema])
    new = given.mapInArrow(_redactor(at), schema)
    if size in names:
        own = place_of(docs, size)
        new = new.withColumn(own, F.when(F.col(at).isNull(), F.col(own)).otherwise(F.length(at).cast(schema[own].dataType)))
    return new.toDF(*names)


def op9_personal_data(spark, sf_dir: str) -> DataFrame:
    return pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
