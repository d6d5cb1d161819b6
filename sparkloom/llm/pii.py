"""Personal information in free text: anchor expansion.

One Aho-Corasick automaton finds anchors (at-signs and their disguises, telephone and identity cues, street words,
words that introduce a person, given names); a deterministic parser at each anchor expands to the boundaries and
validates. Whole texts are scanned.

People: whatever has the shape of a name behind a title, label or signature is one, known or not. Given names met there
in several texts are learnt (`learn_names`, counted by the cluster over all texts) and then are anchors anywhere, as the
common ones of GIVEN are from the start. Identity numbers behind a cue count even if their check digit is wrong (people
mistype them), unless all digits are equal; without a cue, CPF and RUT count if their check digits are right.

Defined results: a null or empty text gives no finding and stays as it is; an item that occurs twice gives two spans;
where spans overlap the earlier kind of (email, phone, national_id, address, person) stands.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

# Common given names of the region and of its neighbours.
GIVEN = """Aurora Alice Alicia Amanda Ana Andrea Andrés Antonio Beatriz Bruno Caio Camila Carla Carlos Carmen Chloé
Clara Claudia Daniel Daniela Diana Diego Eduardo Elena Émile Emma Ernesto Fabián Felipe Fernanda Fernando Francisca
Francisco Gabriel Gabriela Gonzalo Gustavo Helena Henrique Hugo Ignacio Illari Inés Isabel Iván Javier Jean Jimena
Joana João Joaquín Jorge José Juan Juana Julia Julián Julio Killa Laura Leonardo Leticia Louis Lorena Luana Lucas
Lucía Luis Luisa Manuel Manuela Marcela Marcos Mariana María Mario Marta Martin Martín Mateo Mateus Mauricio Miguel
Mónica Natalia Nicolás Nina Nora Otávio Pablo Patricia Paula Paulo Pedro Rafael Ramón Raquel Raúl Renata Ricardo
Roberto Rodrigo Rosa Rubén Samuel Santiago Sebastián Sergio Silvia Sofía Teresa Thiago Tomás Valeria Verónica
Víctor Wayra Yolanda""".split()

# Street words before the name (Spanish, Portuguese), after it (English), after the number (French).
STREET_BEFORE = ["Av.", "Avenida", "Jr.", "Jirón", "Jiron", "Calle", "Pasaje", "Psje.", "Cra.", "Carrera", "R.", "Rua", "Travessa", "Alameda", "Praça", "Praca", "Rodovia"]
STREET_AFTER = ["Street", "St.", "Avenue", "Ave.", "Blvd.", "Boulevard", "Road", "Rd.", "Lane", "Ln.", "Drive"]
STREET_FRENCH = ["rue", "avenue", "chemin", "place", "boulevard", "impasse", "allée", "quai"]

# Cues that stand before a telephone or an identity number.
PHONE_CUES = ["Llame al", "Ligue para", "Call", "Appelez le", "Whatsapp", "WhatsApp", "Zap", "SMS", "Text", "tel.", "tél.", "Tel.", "Tél.", "teléfono", "telefone", "phone", "Phone", "téléphone", "celular", "Celular"]
ID_CUES = ["DNI", "CPF", "RUT", "CURP", "ID", "NIF", "NIE", "documento", "Documento", "document", "Document", "carte", "cédula", "Cédula", "d’identité", "identidad", "identidade", "pasaporte", "passport"]

# What stands before a person: introductions, labels and signatures, titles.
PERSON_CUES = [
    "mi nombre es", "meu nome é", "my name is", "m’appelle", "m'appelle", "pregunte por", "fale com", "ask for", "en nombre de", "a nombre de", "em nome de", "demandez", "on behalf of", "au nom de",
    "contacto:", "contato:", "contact:", "contact :", "firmado por", "assinado por", "signed by", "signé par", "titular", "holder", "titulaire", "coordinador,", "coordinadora,",
    "coordenador,", "coordenadora,", "coordinator,", "coordinado por", "coordenado por", "coordinated by", "is under", "assurée par", "assuré par", "nombre:", "nome:", "name:", "nom :",
]
TITLES = ["Dr.", "Dra.", "Prof.", "Profa.", "Sr.", "Sra.", "Ing.", "Lic.", "Mr.", "Mrs.", "Ms.", "Mme", "Mgtr."]
# Capitalised words that don't begin a person's name.
NOT_NAMES = set(
    "universidad universidade university université facultad faculdade faculty faculté instituto institute institut departamento department département escuela escola school école "
    "centro center centre oficina office bureau secretaría secretaria dirección direção comité comisión comissão laboratorio laboratório laboratory biblioteca library campus sede "
    "san santa são santo saint el la los las un una o a os as the le les l d de del da do dos das en em in señor senhor sir madame dios deus god física curso course".split()
)

_UP, _LOW = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
_SURNAME = rf"(?:[{_UP}][{_LOW}’']+(?:-[{_UP}][{_LOW}]+)?)"
_SURNAME_UP = rf"(?:[{_UP}][{_UP}’']{{2,}})"
_PARTICLE = r"(?:(?:de la|de los|del|de|da|dos|das|do|van|von) )?"
#: A name by its shape alone: two to four capitalised words with initials and particles; surname first, behind a comma or in capitals.
SHAPED = re.compile(
    rf"[ :]*(?:(?:el|la|o|a|the|le) )?(?:(?:Dr|Dra|Prof|Profa|Sr|Sra|Ing|Lic|Mr|Mrs|Ms|Mgtr)\.? |Mme )?"
    rf"((?:{_SURNAME}|{_SURNAME_UP}), {_SURNAME}|{_SURNAME_UP} {_SURNAME}(?!\w)|{_SURNAME}(?: [{_UP}]\.)? {_PARTICLE}{_SURNAME_UP}|{_SURNAME_UP}(?: [{_UP}]\.)?(?: {_SURNAME_UP}){{1,2}}|{_SURNAME}(?: [{_UP}]\.)? {_PARTICLE}{_SURNAME}(?: {_SURNAME})?)(?![\w’-])"
)
CPF, RUT = re.compile(r"(?<![\w.-])\d{3}\.\d{3}\.\d{3}$"), re.compile(r"(?<![\w.-])\d{1,2}\.\d{3}\.\d{3}$")
_DOT = r"(?:\.|\(dot\)|\[dot\]|\(punto\)|\[punto\]|\(ponto\)|\[ponto\])"
LOCAL = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9_%+-]|{_DOT})*( ?)$")
DOMAIN = re.compile(rf" ?(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?{_DOT})+[A-Za-z]{{2,}}")
PHONE = re.compile(
    r"(?:\+\d{2,3}[ .-]?\d{3}[ .-]\d{3}[ .-]\d{3,4}|\+\d{9,13}|\+\d{1,3}(?:[ .-]\(?\d{1,4}\)?){2,5}|00\d{1,3}-\d-\d{3}-\d{4}|00\d{1,3}(?:[ .-]\d{2,4}){2,5}"
    r"|\(0?\d{1,3}\) ?\d{3,4}[ .-]\d{4}|0\d(?:[ .]\d{2}){4}|9[ .]?\d{4}-\d{4}|\d{3}\.\d{3}\.\d{3}|\d{3}[ -]\d{3}[ -]\d{3,4}|\d{9})(?![\d-]|\.\d)"
)
ID = re.compile(
    r"(?:[12] \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{2}\.\d{3}\.\d{3}-[\dA-Z]|\d{1,2}\.\d{3}\.\d{3}\.\d{3}|\d{1,2}\.\d{3}\.\d{3}|\d{7,8}-[\dA-Z]"
    r"|\d{3}-\d{2}-\d{4}|[A-Z]{4}\d{6}[A-Z]{6}[A-Z\d]\d|[A-Z]{1,3}\d{6,9}|\d{2}[A-Z]{2}\d{5}|\d{10,11}|\d{8})(?![\w-]|\.\d)"
)
ID_GAP = re.compile(r"(?: de (?:identidad|identidade)| d’identité)?(?:,? ?:| (?:nro|num|no|nº|n\.º|n°|número|numéro)\.?)? ?")
#: Identity numbers whose form alone tells.
_PREFIX = r"(?:(?:San|Santa|Santo|São|Los|Las|La|El|Dos|Das|Do|Da|de|da|do|dos) ){0,2}"
_NUMBER = r"(?:,? n\.º ?|,? ?N° ?|,? nro\. ?|,? número |,? ?# ?|, | )\d{1,5}(?!\d)"
STREET_TAIL = re.compile(rf" {_PREFIX}[{_UP}][{_UP}{_LOW}]+(?: [{_UP}][{_UP}{_LOW}]+)?{_NUMBER}")
STREET_HEAD = re.compile(rf"(?<!\d)\d{{1,5}} {_SURNAME}(?: {_SURNAME})? $")
FRENCH_HEAD = re.compile(r"(?<!\d)\d{1,5}(?: bis| ter)?,? $")
FRENCH_TAIL = re.compile(rf" (?:de la |de |du |des |d’)?{_SURNAME}")
LAST_FIRST = re.compile(rf"(?<![\w’-])(?:{_SURNAME}|{_SURNAME_UP}), $")
UPPER_FIRST = re.compile(rf"(?<![\w’-]){_SURNAME_UP} $")
NOT_SURNAMES = {"DNI", "CPF", "SMS", "RUT", "CURP", "NIF"}


def checks(number: str) -> bool:
    """Whether the check digits of a CPF (11 digits) or RUT (the last sign) are right."""
    sign = [c for c in number if c.isalnum()]
    if len(set(sign)) == 1:
        return False
    if len(sign) == 11:
        d = [int(c) for c in sign]
        return all(sum(v * w for v, w in zip(d, range(n + 1, 1, -1))) * 10 % 11 % 10 == d[n] for n in (9, 10))
    rest = 11 - sum(int(c) * (2 + k % 6) for k, c in enumerate(reversed(sign[:-1]))) % 11
    return sign[-1].upper() == {11: "0", 10: "K"}.get(rest, str(rest))


class Scanner:
    """The automaton and the parsers; one a worker. `learnt`: given names besides the common ones."""

    def __init__(self, learnt: tuple[str, ...] = ()) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        anchors: dict[str, set[str]] = {}

        def add(kind: str, *texts: str) -> None:
            for t in texts:
                anchors.setdefault(t, set()).add(kind)

        add("at", "@", "(at)", "[at]", "arroba")
        add("plus", "+")
        add("phone", *PHONE_CUES)
        add("id", *ID_CUES)
        add("before", *STREET_BEFORE, *(x.upper() for x in STREET_BEFORE if len(x) > 3))
        add("after", *STREET_AFTER)
        add("french", *STREET_FRENCH)
        variants = set()
        add("check", "-")
        add("cue", *PERSON_CUES, *(x[0].upper() + x[1:] for x in PERSON_CUES), *(x.upper() for x in PERSON_CUES), *TITLES)
        for name in (*GIVEN, *learnt):
            plain = fold(name).capitalize()
            variants |= {name, plain, name.upper(), plain.upper()}
        add("given", *variants)
        given = "|".join(sorted(map(re.escape, variants), key=len, reverse=True))
        self.after = re.compile(rf" (?:(?:{given}) |[{_UP}]\. )?(?:{_SURNAME})(?: {_SURNAME})?(?![\w’-])")
        self.after_upper = re.compile(rf" (?:(?:{given}) |[{_UP}]\. )?(?:{_SURNAME_UP})(?: {_SURNAME_UP})?(?![\w’-])")
        self.variants = variants
        for t, kinds in anchors.items():
            self.automaton.add_word(t, (len(t), tuple(sorted(kinds))))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind), in order of place, without overlap."""
        hits: list[tuple[int, int, int, str]] = []
        given: list[tuple[int, int]] = []
        cued: list[tuple[int, int]] = []
        size = len(text)
        for last, (length, kinds) in self.automaton.iter(text):
            s, e = last - length + 1, last + 1
            for kind in kinds:
                if kind == "at":
                    if (x := self.email(text, s, e)) is not None:
                        hits.append((0, *x, "email"))
                elif kind == "plus" or kind == "phone":
                    if kind == "plus":
                        m = PHONE.match(text, s) if s == 0 or not (text[s - 1].isalnum()) else None
                    else:
                        if s and text[s - 1].isalnum() or e < size and text[e].isalnum():
                            continue
                        at = e
                        while at < size and at < e + 3 and text[at] in " :.":
                            at += 1
                        m = PHONE.match(text, at)
                    if m:
                        hits.append((1, m.start(), m.end(), "phone"))
                elif kind == "id":
                    if s and text[s - 1].isalnum() or e < size and text[e].isalnum():
                        continue
                    gap = ID_GAP.match(text, e)
                    m = ID.match(text, gap.end() if gap else e)
                    if m and len({c for c in m.group() if c.isalnum()}) > 1:
                        hits.append((2, m.start(), m.end(), "national_id"))
                elif kind == "check":
                    for form, tail in ((CPF, r"\d{2}(?![\w-])"), (RUT, r"[\dkK](?![\w-])")):
                        m, n = form.search(text, max(0, s - 12), s), re.compile(tail).match(text, e)
                        if m and n and checks(text[m.start() : n.end()]):
                            hits.append((2, m.start(), n.end(), "national_id"))
                elif kind == "cue":
                    if s and text[s - 1].isalnum() or text[e - 1].isalnum() and e < size and text[e].isalnum():
                        continue
                    if (m := SHAPED.match(text, e)) and not ({fold(w) for w in re.findall(r"\w\w+", m.group(1))} & _NOT):
                        cued.append(m.span(1))
                elif kind == "given":
                    if (s and (text[s - 1].isalnum() or text[s - 1] in "@._+-")) or (e < size and (text[e].isalnum() or text[e] in "@_+-")):
                        continue
                    given.append((s, e))
                elif (x := self.address(text, s, e, kind)) is not None:
                    hits.append((3, *x, "address"))
        hits.sort()
        taken: list[tuple[int, int, str]] = []

        def free(s: int, e: int) -> bool:
            return all(e <= a or s >= b for a, b, _ in taken)

        for _, s, e, kind in hits:
            if free(s, e):
                taken.append((s, e, kind))
        at = 0
        for s, e in given:
            if s >= at and (x := self.person(text, s, e)) is not None and free(*x):
                taken.append((*x, "person"))
                at = x[1]
        for s, e in cued:
            if free(s, e):
                taken.append((s, e, "person"))
        return sorted(taken)

    def introduced(self, text: str) -> list[str]:
        """Given names of those behind a cue whom the scanner doesn't know by name."""
        out = []
        for s, e, kind in self.spans(text):
            if kind == "person":
                value = text[s:e]
                first = value.split(", ")[1] if ", " in value else value.split()[1] if value.split()[0].isupper() and not value.isupper() else value.split()[0]
                if first not in self.variants and len(first) > 2 and first.isalpha():
                    out.append(first.capitalize())
        return out

    def email(self, text: str, s: int, e: int) -> tuple[int, int] | None:
        if text[s:e] == "arroba":  # with or without brackets
            while s and text[s - 1] in "[(":
                s -= 1
            while e < len(text) and text[e] in "])":
                e += 1
        head = LOCAL.search(text, max(0, s - 90), s)
        tail = DOMAIN.match(text, e)
        if not head or not tail or (head.group(1) == "") != (not tail.group(0).startswith(" ")):
            return None
        return head.start(), tail.end()

    def address(self, text: str, s: int, e: int, kind: str) -> tuple[int, int] | None:
        if s and text[s - 1].isalnum():
            return None
        if kind == "before":
            m = STREET_TAIL.match(text, e)
            return (s, m.end()) if m else None
        if kind == "after":
            if text[e - 1] != "." and e < len(text) and text[e].isalnum():
                return None
            m = STREET_HEAD.search(text, max(0, s - 60), s)
            return (m.start(), e) if m else None
        head, tail = FRENCH_HEAD.search(text, max(0, s - 14), s), FRENCH_TAIL.match(text, e)
        return (head.start(), tail.end()) if head and tail else None

    def person(self, text: str, s: int, e: int) -> tuple[int, int] | None:
        upper = text[s:e].isupper()
        if m := (self.after_upper if upper else self.after).match(text, e):
            return s, m.end()
        if upper:
            if m := LAST_FIRST.search(text, max(0, s - 40), s):
                return m.start(), e
            return None
        for pattern in (LAST_FIRST, UPPER_FIRST):
            m = pattern.search(text, max(0, s - 40), s)
            if m and m.group(0).strip(", ") not in NOT_SURNAMES and m.group(0).strip(", ") not in self.variants:
                return m.start(), e
        return None


_NOT = {fold(w) for w in NOT_NAMES}


@lru_cache(maxsize=2)
def scanner(learnt: tuple[str, ...] = ()) -> Scanner:
    return Scanner(learnt)


def learn_names(df: DataFrame, text_col: str, least: int = 3) -> tuple[str, ...]:
    """Given names, besides the common ones, that stand behind a cue in at least `least` different texts; counted by the cluster over all
    texts. Given names are few however many texts there are, so the list is small."""

    def run(batches):
        from collections import Counter

        scan = scanner()
        for pdf in batches:
            counts = Counter(n for t in pdf[text_col] if t for n in set(scan.introduced(t)))
            yield pd.DataFrame({"name": pd.Series(list(counts), dtype=object), "n": pd.Series(list(counts.values()), dtype="int64")})

    counted = df.select(text_col).where(F.col(text_col).isNotNull()).mapInPandas(run, "name string, n bigint").groupBy("name").agg(F.sum("n").alias("n"))
    return tuple(sorted(r["name"] for r in counted.where(F.col("n") >= least).collect()))


def find_pii(df: DataFrame, id_col: str, text_col: str, learnt: tuple[str, ...] = ()) -> DataFrame:
    """(id, kind, value, start, end) of each piece; offsets count characters from 0. `learnt`: names of `learn_names`."""

    def run(batches):
        scan = scanner(learnt)
        for pdf in batches:
            ids, kinds, values, starts, ends = [], [], [], [], []
            for i, text in zip(pdf[id_col], pdf[text_col]):
                if text:
                    for s, e, kind in scan.spans(text):
                        ids.append(i), kinds.append(kind), values.append(text[s:e]), starts.append(s), ends.append(e)
            yield pd.DataFrame({id_col: pd.Series(ids, dtype=pdf[id_col].dtype), "kind": pd.Series(kinds, dtype=object), "pii_value": pd.Series(values, dtype=object), "start": pd.Series(starts, dtype="int64"), "end": pd.Series(ends, dtype="int64")})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).mapInPandas(run, f"`{id_col}` {kind}, kind string, pii_value string, start bigint, end bigint")


def redact(df: DataFrame, text_col: str, out_col: str = "redacted_text", learnt: tuple[str, ...] = ()) -> DataFrame:
    """The rows with the text in which typed placeholders such as [EMAIL] stand for the pieces; null stays null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        scan, out = scanner(learnt), []
        for text in texts:
            if text:
                parts, at = [], 0
                for s, e, kind in scan.spans(text):
                    parts += [text[at:s], f"[{kind.upper()}]"]
                    at = e
                text = "".join(parts) + text[at:]
            out.append(text)
        return pd.Series(out, dtype="object")

    return df.withColumn(out_col, clean(F.col(text_col)))
