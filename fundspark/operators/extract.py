"""Fields of a prospectus or key information document, by labels in front of values.

A table says which words announce each field and which form its value has; one
reader finds the label, passes over what joins label and value, and reads the
form. Sentences and table rows are read where a field has no label of its
own. Texts are compared without accents, values come out as written. Each
field has, in ``confidence``, how it was found: exact (label and form),
proximity (near its words), table, inferred (from what the text says of it) or missing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pyarrow as pa

EXACT, PROXIMITY, TABLE, INFERRED, MISSING = "exact", "proximity", "table", "inferred", "missing"

# Words in front of each field's value, without accents, in fr, en, de, es; the form of the value.
LABELS: dict[str, tuple[str, tuple[str, ...]]] = {
    "nom_produit": ("title", ("a pour denomination", "denomination du produit", "denomination du fonds", "denomination", "nom du produit", "nom du fonds", "product name", "fund name", "produktname", "fondsname", "nombre del fondo")),
    "identifiant": ("code", ("identifiant", "reference", "code amf", "agrement amf", "visa", "registration number", "kennnummer")),
    "devise": ("currency", ("devise de reference", "devise", "monnaie", "reference currency", "currency of the fund", "currency", "wahrung", "divisa")),
    "societe_gestion": ("name", ("societe de gestion", "management company", "gestionnaire", "verwaltungsgesellschaft", "sociedad gestora", "initiateur", "fabricant", "manufacturer", "producteur")),
    "depositaire": ("name", ("depositaire", "depositary", "custodian", "verwahrstelle", "depositario")),
    "teneur_comptes": ("name", ("teneur de comptes-conservateur", "teneur de comptes", "teneur de compte", "account keeper", "transfer agent", "agent de transfert", "centralisateur")),
    "commissaire_comptes": ("name", ("commissaire aux comptes", "statutory auditor", "auditor", "wirtschaftsprufer", "cabinet d'audit", "audit firm")),
    "type_produit": ("title", ("type de produit", "type of product", "product type", "type", "art des produkts")),
    "classification": ("title", ("classification amf", "classification", "morningstar category", "lipper category", "categorie morningstar")),
    "duree": ("term", ("duree du fonds", "duree du produit", "duree de vie", "cree pour une duree de", "duree", "duration", "laufzeit")),
    "valeur_initiale_part": ("amount", ("valeur initiale de la part", "valeur initiale", "valeur d'origine", "initial nav", "initial net asset value", "prix d'emission initial", "valeur nominale", "nominal value", "vl initiale")),
    "date_document": ("day", ("document d'informations cles", "date de production", "date du document", "date of the document", "date of the kid", "this document was produced on", "this document was published on", "produced on", "published on", "datum des dokuments", "fecha del documento", "date")),
    "domicile": ("country", ("domicile", "domiciliation", "country of domicile", "country of registration", "agree en", "authorised in", "registered in", "pays de domiciliation")),
    "indice_reference": ("index", ("indice de reference", "indicateur de reference", "benchmark", "reference index", "referenzindex", "indice de referencia")),
    "periode_detention": ("span", ("periode de detention recommandee", "duree de placement recommandee", "recommended holding period", "empfohlene haltedauer", "conserver votre investissement pendant", "detenir votre investissement", "hold your investment for")),
    "sri": ("scale", ("classe de risque", "risk class", "indicateur synthetique de risque", "indicateur de risque", "summary risk indicator", "gesamtrisikoindikator", "risikoklasse")),
    "srri": ("digit", ("srri", "profil de risque et de rendement", "risk and reward profile")),
    "lei": ("lei", ("lei", "legal entity identifier", "identifiant d'entite juridique")),
}

# Words in front of each cost.
COSTS: dict[str, tuple[str, ...]] = {
    "commission_souscription": ("commission de souscription", "couts d'entree", "frais d'entree", "entry cost", "entry charge", "subscription fee", "initial charge", "front-end load", "ausgabeaufschlag", "comision de suscripcion"),
    "commission_rachat": ("commission de rachat", "couts de sortie", "frais de sortie", "exit cost", "exit charge", "redemption fee", "back-end load", "rucknahmeabschlag", "comision de reembolso"),
    "frais_gestion": ("frais de gestion financiere", "frais de gestion", "management fee", "annual management charge", "management charge", "verwaltungsgebuhr", "verwaltungsvergutung", "comision de gestion"),
    "frais_courants": ("frais courants", "ongoing charges", "ongoing costs", "laufende kosten", "frais recurrents", "gestion et autres couts administratifs", "gastos corrientes"),
    "frais_fonctionnement": ("frais de fonctionnement", "frais administratifs", "operating cost", "operating expense", "betriebskosten"),
    "frais_indirects": ("frais indirects", "indirect cost", "underlying fund cost", "acquired fund fees", "kosten der zugrunde"),
    "couts_transaction": ("couts de transaction", "frais de transaction", "transaction cost", "portfolio transaction", "transaktionskosten"),
    "commission_surperformance": ("commission de surperformance", "commissions de surperformance", "commission liee aux resultats", "commissions liees aux resultats", "performance fee", "success fee", "erfolgsbezogene vergutung"),
}

# Word lists, without accents.
LEGAL_FORMS = ("FCPE", "FCPR", "FCPI", "FCP", "SICAV-SIF", "SICAV", "OPCVM", "UCITS", "FIA", "AIF", "ETF", "FIC", "ELTIF", "RAIF", "SCS", "SCA", "SA")
PROVIDERS = ("MSCI", "EURO STOXX", "STOXX", "CAC", "FTSE", "S&P", "Bloomberg", "Barclays", "JP Morgan", "ICE BofA", "BofA", "EONIA", "€STR", "SOFR", "SONIA", "DAX", "Russell", "Nikkei", "TOPIX")
CURRENCIES = {"eur": "EUR", "euro": "EUR", "euros": "EUR", "€": "EUR", "usd": "USD", "$": "USD", "gbp": "GBP", "£": "GBP", "chf": "CHF", "jpy": "JPY", "¥": "JPY", "sek": "SEK", "nok": "NOK", "dkk": "DKK", "cad": "CAD", "aud": "AUD"}
MONTHS = "january february march april may june july august september october november december janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre januar februar marz juni juli oktober dezember".split()
NONE = ("neant", "aucun", "aucune", "none", "n/a", "nil", "keine", "ninguna", "pas de commission", "pas de frais", "no fee")
JOINING = frozenset("de du des la le les et d'un and of the fur und von y & del".split())
OBJECTIVE = ("objectif de gestion", "objectifs et politique d'investissement", "investment objective", "objectives and investment policy", "anlageziel", "ziele und anlagepolitik", "objetivo de inversion")
INCOME = ("affectation des sommes", "affectation du resultat", "politique de distribution", "distribution policy", "income treatment", "ertragsverwendung")
ACCUMULATES = ("capitalis", "reinvesti", "accumulat", "thesaurier", "non-distribution", "non distribution", "acumulacion")
DISTRIBUTES = ("parts de distribution", "part de distribution", "distributing", "distribuera", "distribue", "ausschutt", "reparto")
LOSSES = ("perdre tout", "pas de protection", "n'est pas garanti", "aucun rendement minimal garanti", "vous pourriez perdre", "you could lose", "lose all", "lose your entire", "no capital protection", "no guarantee", "not guaranteed", "kein kapitalschutz", "podria perder")
GUARANTEES = ("capital garanti", "garantie du capital", "capital protection", "capital guaranteed", "kapitalgarantie", "capital garantizado")
EQUITY = ("exposition", "expose", "investi", "exposure", "exposed", "invested", "actions", "equit", "aktien")
SUSTAINABLE, ALIGNED, LEAST = ("investissements durables", "investissement durable", "sustainable investment", "nachhaltige investitionen"), ("taxonomie", "taxonomy"), ("minim", "au moins", "at least", "mindest", "proportion")
SFDR = ("sfdr", "2019/2088", "disclosure", "durabilite", "sustainability", "reglement", "regulation", "classe article", "releve de l'article", "falls under")
ESG = (
    ("Best-in-class", ("best-in-class", "best in class")), ("Best-in-universe", ("best-in-universe", "best in universe")), ("Best-effort", ("best-effort", "best effort")), ("Impact investing", ("impact invest", "investissement a impact")),
    ("Label ISR", ("label isr", "sri label", "isr certified")), ("Greenfin / Transition", ("greenfin", "transition energetique", "towards sustainability")), ("Exclusion + integration ESG", ("exclusion",)), ("Integration ESG", ("integration esg", "esg integration")),
)
SCENARIOS = (
    ("Scénario de tensions", ("tensions", "stress", "stressszenario", "tension")), ("Scénario défavorable", ("defavorable", "unfavourable", "unfavorable", "pessimistisches", "pessimistisch", "desfavorable")),
    ("Scénario intermédiaire", ("intermediaire", "moderate", "mittleres", "moderado")), ("Scénario favorable", ("favorable", "favourable", "optimistisches", "optimistisch")),
)
TOTALS, IMPACT = ("couts totaux", "total costs", "gesamtkosten", "costes totales"), ("incidence des couts", "incidence annuelle", "annual cost impact", "impact on return", "reduction in yield", "riy", "auswirkungen der kosten")

FIELDS = (
    "nom_produit type_produit classification societe_gestion depositaire teneur_comptes commissaire_comptes devise isin identifiant lei duree date_document valeur_initiale_part domicile forme_juridique "
    "indice_reference objectif_gestion exposition_min exposition_max politique_distribution sri srri periode_detention capital_garanti commission_souscription commission_rachat frais_gestion frais_courants "
    "frais_fonctionnement frais_indirects couts_transaction commission_surperformance couts_totaux_1an couts_totaux_detention incidence_annuelle_1an incidence_annuelle_detention classification_sfdr "
    "investissements_durables_min approche_esg taxonomie_min"
).split()
SCENARIO = "scenario valeur_1an rendement_1an valeur_detention rendement_detention extraction_method".split()

# How far a cost's value may stand behind its words, its absence, and figures around a scenario's name; most characters of an objective.
COST_REACH, NONE_REACH, SCENARIO_REACH, OBJECTIVE_CHARS = 300, 120, 250, 300

_NUM = r"\d{1,3}(?:[ .'  ]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?"
_MONEY = r"€|eur\b|euros?\b|usd\b|\$|gbp\b|£|chf\b|jpy\b|¥"
# What the value of each form looks like where it begins, on folded text.
_FORMS = {
    "title": r"[^\n]{3,150}", "name": r"[^\n]{3,120}", "index": r"[^\n]{3,90}", "code": r"[a-z]{0,4}\d{6,15}\b", "currency": "|".join(rf"{k}(?![a-z])" if k.isalpha() else rf"[{k}]" for k in CURRENCIES),
    "amount": rf"(?:{_NUM})\s?(?:{_MONEY})|(?:{_MONEY})\s?(?:{_NUM})", "percent": rf"(?:{_NUM})\s?%",
    "day": rf"\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}(?:er)?\.? (?:de )?(?:{'|'.join(MONTHS)})\.? (?:de )?\d{{4}}|(?:{'|'.join(MONTHS)}) \d{{1,2}}, \d{{4}}",
    "country": r"[^\W\d_]{2,}(?:[ -][^\W\d_]{2,}){0,2}", "span": r"(?:(?:plus de|au moins|more than|at least|mindestens) )?\d{1,2}\s?(?:ans?|annees?|years?|jahre?|mois|months?|monate?|anos?)\b",
    "term": r"(?:plus de |au moins )?\d{1,3}\s?(?:ans?|annees?|years?|jahre?|anos?)\b|indeterminee|illimitee|unlimited|indefinite|unbefristet", "return": rf"(?<![\d.,])[-+]?(?:{_NUM})\s?%",
    "scale": r"\d\s?(?:sur|/|out of|on|von|auf|de)\s?(?:(?:une echelle de|a scale of|a scale from|einer skala von|una escala de) 1 (?:a|to|bis) )?\d", "digit": r"\d(?!\d)", "lei": r"[a-z0-9]{18}\d{2}\b",
}
# What may stand between a label and its value.
_JOIN = r"(?:[\s:=|*()»«\"–-]|(?:du|de|des|of|the|le|la|les|l'|est|is|are|was|ist|es|el|au|a|par|in|se situe a|for|pendant|recommandee|minimum)(?=[\s:'(])'?){0,12}"


def fold(text: str) -> str:
    """Lower case without accents, with plain quotes, dashes and blanks; as long as ``text``."""
    return text.lower() if text.isascii() else text.translate(_folded()).lower()


class _Fold(dict):
    """Character by character, filled as characters come up."""

    def __missing__(self, code: int) -> str:
        import unicodedata

        c = chr(code)
        if c in "’‘`´":
            out = "'"
        elif c in "“”«»":
            out = '"'
        elif unicodedata.category(c) == "Pd":
            out = "-"
        elif c.isspace() and c not in "\n\r\t":
            out = " "
        else:
            out = unicodedata.normalize("NFD", c)[0]
        self[code] = out if len(out.lower()) == 1 else c
        return self[code]


_KEPT: dict = {}


def _folded() -> _Fold:
    return _KEPT.setdefault("fold", _Fold())


def _re(pattern: str):
    import re

    if pattern not in _KEPT:
        _KEPT[pattern] = re.compile(pattern)
    return _KEPT[pattern]


def _words_at(low: str, word: str) -> Iterator[int]:
    """Places where a label stands as words of its own."""
    at = low.find(word)
    while at >= 0:
        end = at + len(word)
        if (at == 0 or not low[at - 1].isalnum()) and (end == len(low) or not low[end].isalnum() or low[end] == "s"):
            yield at
        at = low.find(word, at + 1)


class Reader:
    """One text, as written and folded, with its sentences and table rows."""

    def __init__(self, text: str):
        self.text = text.replace("\r\n", "\n").replace("ﬁ", "fi").replace("ﬂ", "fl").replace("­", "")
        self.low = fold(self.text)
        self._sentences: list[tuple[int, int]] | None = None

    def shown(self, a: int, b: int) -> str:
        return " ".join(self.text[a:b].split())

    @property
    def sentences(self) -> list[tuple[int, int]]:
        if self._sentences is None:
            cuts = [0, *(m.end() for m in _re(r"[.!?;](?=\s)\s*|\n+").finditer(self.low)), len(self.low)]
            self._sentences = [(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]
        return self._sentences

    def rows(self) -> Iterator[str]:
        """Lines that are rows of a table: cells between bars or tabs."""
        for line in self.text.split("\n"):
            if line.count("|") > 1 or line.count("\t") > 1:
                yield line

    def behind(self, label: str, form: str) -> Iterator[tuple[int, int]]:
        """Spans of values of a form right behind a label."""
        value, join = _re(_FORMS[form]), _re(_JOIN)
        for at in _words_at(self.low, label):
            start = at + len(label)
            start += self.low[start : start + 1] == "s"
            m = value.match(self.low, join.match(self.low, start).end())
            if m and ("\n" not in self.low[start : m.start()] or form not in ("title", "name", "index", "country")):
                yield m.span()

    def labelled(self, field: str) -> str | None:
        form, labels = LABELS[field]
        for label in labels:
            for a, b in self.behind(label, form):
                got = _trimmed(self, a, b, form)
                if got:
                    return got
        return None

    def figures(self, a: int, b: int, form: str) -> list[str]:
        return [self.shown(*m.span()) for m in _re(_FORMS[form]).finditer(self.low, max(a, 0), min(b, len(self.low)))]

    def near(self, words: tuple[str, ...], *others: tuple[str, ...]) -> Iterator[tuple[int, int]]:
        """Sentences that hold one of ``words`` and one of each of ``others``."""
        for a, b in self.sentences:
            s = self.low[a:b]
            if any(w in s for w in words) and all(any(w in s for w in o) for o in others):
                yield a, b


def _trimmed(r: Reader, a: int, b: int, form: str) -> str | None:
    """The value of a form, cut where it ends."""
    if form in ("name", "index", "title"):
        stop = _re({"name": r"[,;(\n]|\.\s|\.$|\s{3,}", "title": r"[;\n]|\.\s|\.$|\s{3,}", "index": r"[,;(\n]|\.\s|\.$|\s(?:dividendes|net return|total return|nr|tr|avec|index)\b"}[form])
        m = stop.search(r.low, a, b)
        out = r.shown(a, m.start() if m else b).strip(" \"'«»:-")
        if form == "name":
            # a name ends before the first word in lower case that doesn't join its parts
            words = out.split(" ")
            out = " ".join(words[: next((k for k, w in enumerate(words) if k and w[0].islower() and fold(w) not in JOINING), len(words))])
        if form == "title":
            out = out[:80].rsplit(" ", 1)[0] if len(out) > 80 else out
        return out if len(out) >= 3 and any(c.isalpha() for c in out) and (form == "title" or out[0].isupper() or out[0].isdigit() or not out[0].isalpha()) else None
    if form == "currency":
        return CURRENCIES[r.low[a:b]]
    if form == "country":
        out = r.shown(a, b)
        words = [w for k, w in enumerate(out.split()) if k == 0 or w[0].isupper()]
        return " ".join(words) if out[0].isupper() else None
    if form in ("code", "lei"):
        return r.shown(a, b).upper()
    if form == "scale":
        low, *_, high = [c for c in r.low[a:b] if c.isdigit()]
        return f"{low} / {high}"
    return r.shown(a, b)


def isin_digit(code: str) -> bool:
    """Whether the check digit of an ISIN is right: letters count as two digits, every second digit from the right is doubled, digits add up to tens."""
    digits = "".join(str(int(c, 36)) for c in code)
    doubled = (str(int(d) * (1 + k % 2)) for k, d in enumerate(reversed(digits)))
    return sum(int(x) for d in doubled for x in d) % 10 == 0


def _cost(r: Reader, labels: tuple[str, ...]) -> str | None:
    """The first label, in order, behind which a cost is told: none at all, a percentage (and that it is the most), or an amount."""
    for label in labels:
        at = r.low.find(label)
        if at < 0:
            continue
        end = at + COST_REACH
        head = r.low[at : at + NONE_REACH]
        zero = _re(r"(?<![\d.,])0[.,]00(?!\d)")
        if any(_re(rf"(?<!\w){w}(?!\w)").search(head) for w in NONE) or zero.search(head):
            return "Néant"
        m = _re(rf"(?<![\d.,])\d{{1,2}}(?:[.,]\d{{1,4}})?\s?%").search(r.low, at, min(end, len(r.low)))
        if m:
            return r.shown(*m.span()) + (" maximum" if "max" in r.low[m.end() : m.end() + 40] else "")
        amount = r.figures(at, end, "amount")
        if amount:
            return amount[0]
    return None


def _two(r: Reader, words: tuple[str, ...], form: str, reach: int = 90) -> list[str]:
    """Two figures of a form behind one of the words."""
    for w in words:
        for at in _words_at(r.low, w):
            got = r.figures(at, at + len(w) + reach, form)
            if len(got) >= 2:
                return got[:2]
    return []


def _euros(amount: str) -> str:
    return "€" + " ".join(_re(rf"{_NUM}").search(amount).group().split())


def _scenario(r: Reader, words: tuple[str, ...], part: str) -> tuple[list[str], list[str]]:
    """Amounts and returns of a scenario: from the lines above and below its name (``lines``), around it (``near``), or from table rows (``rows``)."""
    amounts, shares = [], []
    if part == "rows":
        for row in r.rows():
            own = Reader(row)
            if any(next(_words_at(own.low, w), -1) >= 0 for w in words):
                amounts, shares = amounts or own.figures(0, len(row), "amount"), shares or own.figures(0, len(row), "return")
        return amounts, shares
    for w in words:
        for at in _words_at(r.low, w):
            if part == "near":
                amounts, shares = (r.figures(at - SCENARIO_REACH, at + SCENARIO_REACH, form) for form in ("amount", "return"))
                amounts = [a for a in amounts if sum(c.isdigit() for c in a) > 2]
                if amounts or shares:
                    return amounts, shares
                continue
            a = r.low.rfind("\n", 0, at) + 1
            above = r.low.rfind("\n", 0, max(a - 1, 0)) + 1
            b = r.low.find("\n", at)
            b = len(r.low) if b < 0 else b
            below = r.low.find("\n", b + 1)
            below = len(r.low) if below < 0 else below
            amounts, shares = r.figures(above, b, "amount"), r.figures(a, below, "return")
            if len(amounts) >= 2 and len(shares) >= 2:
                return amounts[-2:], shares[:2]
    return [], []


def scenarios(r: Reader) -> list[dict]:
    """What an investor gets back in each scenario. Lines are read first; table rows, then what is near a name, only where fewer than two scenarios were found so far."""
    found: dict[str, dict] = {}
    for part, how in (("lines", EXACT), ("rows", TABLE), ("near", PROXIMITY)):
        if part != "lines" and len(found) > 1:
            break
        for label, words in SCENARIOS:
            if label in found:
                continue
            amounts, shares = _scenario(r, words, part)
            if amounts or shares:
                at = lambda x, k, show: show(x[k]) if len(x) > k else None
                percent = lambda s: s.replace(" ", "")
                values = (label, at(amounts, 0, _euros), at(shares, 0, percent), at(amounts, 1, _euros), at(shares, 1, percent), how)
                found[label] = dict(zip(SCENARIO, values))
    return [found[label] for label, _ in SCENARIOS if label in found]


def fields_of(text: str) -> tuple[dict[str, str], dict[str, str], list[dict]]:
    """(values, how each was found, scenarios) of a text; fields not found are left out."""
    r = Reader(text)
    out: dict[str, str] = {}
    how: dict[str, str] = {}

    def keep(name: str, value: str | None, method: str = EXACT) -> None:
        if value and name not in out:
            out[name], how[name] = value, method

    for name in LABELS:
        keep(name, r.labelled(name))
    _identity(r, keep, out)
    _policy(r, keep)
    for name, labels in COSTS.items():
        keep(name, _cost(r, labels))
    _cost_fallbacks(r, keep)
    _sustainability(r, keep)
    _finish(out, how)
    return out, how, scenarios(r)


def _identity(r: Reader, keep, out: dict) -> None:
    lines = r.text.split("\n")
    for k, line in enumerate(lines[:-1]):
        if fold(line).strip(" :") in ("produit", "product", "produkt"):
            keep("nom_produit", " ".join(lines[k + 1].split())[:80])
    for line in lines:
        flat = " ".join(line.split())
        if 6 <= len(flat) <= 61 and flat.isupper() and sum(c.isalpha() for c in flat) > len(flat) / 2:
            keep("nom_produit", flat, PROXIMITY)
            break
    codes = [m.group() for m in _re(r"\b[A-Z]{2}[A-Z0-9]{9}\d\b").finditer(r.text) if sum(c.isdigit() for c in m.group()) > 1]
    keep("isin", next((c for c in codes if isin_digit(c)), None))
    keep("isin", next(iter(codes), None), PROXIMITY)
    keep("lei", next((m.group() for m in _re(r"\b(?=[A-Z0-9]*[A-Z])\d{4,6}[A-Z0-9]{12,14}\d{2}\b").finditer(r.text) if len(m.group()) == 20), None), PROXIMITY)
    forms = {f: m.start() for f in LEGAL_FORMS if (m := _re(rf"\b{f}\b").search(r.text))}
    if forms:
        first = min(forms, key=lambda f: (forms[f], -len(f)))
        keep("forme_juridique", first)
        end = _re(r"[.\n]").search(r.text, forms[first])
        kind = r.shown(forms[first], end.start() if end else len(r.text))
        keep("type_produit", kind[:110] if len(kind) > len(first) + 5 else None, PROXIMITY)
    providers = [(r.text.find(p), p) for p in PROVIDERS if _re(rf"(?<!\w){p.replace('&', '[&]')}(?!\w)").search(r.text)]
    if providers:
        at = min(providers)[0]
        keep("indice_reference", _trimmed(r, at, min(at + 90, len(r.text)), "index"), PROXIMITY)
    for a, b in r.near(("classe", "class"), ("risque", "risk", "risiko")):
        m = _re(_FORMS["scale"]).search(r.low, a, b)
        keep("sri", _trimmed(r, *m.span(), "scale") if m else None, PROXIMITY)


def _policy(r: Reader, keep) -> None:
    for word in OBJECTIVE:
        at = r.low.find(word)
        if at >= 0:
            # up to the next heading in capitals
            end = next((m.start() for m in _re(r"\n[A-Z][A-Z \-']{4,60}\n").finditer(r.text, at)), len(r.text))
            told = r.shown(at, min(end, at + 500))
            keep("objectif_gestion", told if len(told) <= OBJECTIVE_CHARS else told[:OBJECTIVE_CHARS].rsplit(" ", 1)[0] + "...")
    for a, b in r.near(EQUITY, ("%",)):
        s = r.low[a:b]
        pair = _re(r"(?:entre|between|de|from|von|minimum|min\.?|of)?\s?(\d{1,3})\s?%?\s?(?:et|and|a|to|bis|-|au|[^.%]{0,40}max(?:imum|\.)?(?: de| of)?)\s?(\d{1,3})\s?%").search(s)
        if pair and int(pair[1]) <= int(pair[2]) <= 300:
            keep("exposition_min", f"{pair[1]} %")
            keep("exposition_max", f"{pair[2]} %")
    for word in INCOME:
        at = r.low.find(word)
        if at >= 0:
            told = r.low[at + len(word) : at + len(word) + 250]
            both = ("Capitalisation" if any(w in told for w in ACCUMULATES) else "", "Distribution" if any(w in told.replace("non-distribution", "").replace("non distribution", "") for w in DISTRIBUTES) else "")
            keep("politique_distribution", " / ".join(x for x in both if x))
    for a, b in r.near(("revenus", "resultat", "parts", "income"), ACCUMULATES):
        keep("politique_distribution", "Capitalisation", INFERRED)
    if any(w in r.low for w in LOSSES):
        keep("capital_garanti", "Non", INFERRED)
    elif any(w in r.low for w in GUARANTEES):
        keep("capital_garanti", "Oui", INFERRED)


def _cost_fallbacks(r: Reader, keep) -> None:
    for a, b in r.near(("transaction", "transaktion")):
        keep("couts_transaction", next(iter(r.figures(a, b, "amount")), None), PROXIMITY)
    for a, b in r.near(("surperformance", "performance fee", "success fee", "liees aux resultats", "erfolgsbezogen"), NONE + ("pas de", "il n'y a pas", "no ")):
        keep("commission_surperformance", "Néant", INFERRED)
    totals, impact = _two(r, TOTALS, "amount"), _two(r, IMPACT, "percent")
    for name, got, show in (("couts_totaux", totals, _euros), ("incidence_annuelle", impact, str)):
        for suffix, x in zip(("1an", "detention"), got):
            keep(f"{name}_{suffix}", show(x))
    for row in r.rows():
        own = Reader(row)
        if "total" in own.low and ("cout" in own.low or "cost" in own.low):
            for suffix, x in zip(("1an", "detention"), own.figures(0, len(row), "amount")):
                keep(f"couts_totaux_{suffix}", _euros(x), TABLE)
        if any(w in own.low for w in ("incidence", "impact", "riy")):
            for suffix, x in zip(("1an", "detention"), own.figures(0, len(row), "percent")):
                keep(f"incidence_annuelle_{suffix}", x, TABLE)


def _sustainability(r: Reader, keep) -> None:
    for a, b in r.near(SFDR, ("art",)):
        m = _re(r"\bart(?:icle|\.)?\s?([689])\b").search(r.low, a, b)
        keep("classification_sfdr", f"Article {m[1]}" if m else None)
    for name, words in (("investissements_durables_min", SUSTAINABLE), ("taxonomie_min", ALIGNED)):
        for a, b in r.near(words, ("%",)):
            got = r.figures(a, b, "percent")
            keep(name, got[0].replace(" ", "").replace("%", " %") if got else None, EXACT if any(w in r.low[a:b] for w in LEAST) else PROXIMITY)
    for label, words in ESG:
        if any(w in r.low for w in words) and (label != "Exclusion + integration ESG" or "esg" in r.low):
            keep("approche_esg", label)


def _finish(out: dict, how: dict) -> None:
    if "duree" in out:
        years, low = _re(r"(\d+)\s*ans?\b").search(fold(out["duree"])), fold(out["duree"])
        out["duree"] = f"{years[1]} ans" if years else "Indéterminée" if "indetermin" in low or "illimit" in low else out["duree"]
    if "srri" in out:
        out["srri"] = f"{out['srri']} / 7"
        if "sri" not in out:
            out["sri"], how["sri"] = out["srri"], how["srri"]


def extract(docs: DataFrame, key: str = "source_file", text: str = "text") -> DataFrame:
    """One row per row of ``docs`` (``key``, ``text``; other columns are dropped): all FIELDS, ``scenarios``, ``confidence`` and the numbers of fields found and in all.

    Whole texts in Arrow batches without a shuffle, equal texts of a batch once. Null and empty texts give nulls and no field found.
    """
    kind = dict(docs.dtypes)[key]
    scenario = ", ".join(f"{c}: string" for c in SCENARIO)
    schema = f"`{key}` {kind}, " + ", ".join(f"{n} string" for n in FIELDS) + f", scenarios array<struct<{scenario}>>, confidence map<string, string>, champs_trouves int, champs_total int"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        struct = pa.list_(pa.struct([(c, pa.string()) for c in SCENARIO]))
        for batch in batches:
            known: dict[str, tuple] = {}
            rows = []
            for t in batch.column(1).to_pylist():
                if t not in known:
                    known[t] = fields_of(t) if t else ({}, {}, [])
                rows.append(known[t])
            cols = [batch.column(0), *(pa.array([v.get(n) for v, _, _ in rows], pa.string()) for n in FIELDS)]
            cols.append(pa.array([s for _, _, s in rows], struct))
            cols.append(pa.array([[(n, h.get(n, MISSING)) for n in FIELDS] for _, h, _ in rows], pa.map_(pa.string(), pa.string())))
            cols.append(pa.array([len(v) + bool(s) for v, _, s in rows], pa.int32()))
            cols.append(pa.array([len(FIELDS) + 1] * len(rows), pa.int32()))
            yield pa.record_batch(cols, names=[key, *FIELDS, "scenarios", "confidence", "champs_trouves", "champs_total"])

    return docs.select(key, text).mapInArrow(read, schema)


def confidence_counts(extracted: DataFrame) -> DataFrame:
    """How many fields were found in each way."""
    return extracted.select(F.explode("confidence").alias("field", "how")).groupBy("how").agg(F.count(F.lit(1)).alias("n"))


def fill_rates(extracted: DataFrame, key: str = "source_file") -> DataFrame:
    """Fields found, counted from the cells themselves (scenarios count as one), and their share in percent, of each row."""
    filled = sum((F.when(F.trim(F.coalesce(F.col(n), F.lit(""))) != "", 1).otherwise(0) for n in FIELDS), F.when(F.size(F.coalesce("scenarios", F.array())) > 0, 1).otherwise(0))
    return extracted.select(key, filled.alias("found"), F.floor(filled * 100 / (len(FIELDS) + 1)).cast("int").alias("percent"))


def flat_scenarios(extracted: DataFrame, most: int = 4) -> DataFrame:
    """A plain row each, for CSV: the array of scenarios as columns scenario_1_scenario, scenario_1_valeur_1an ...; absent ones are null."""
    cols = [F.get("scenarios", F.lit(k))[c].alias(f"scenario_{k + 1}_{c}") for k in range(most) for c in SCENARIO]
    return extracted.select(*[c for c in extracted.columns if c not in ("scenarios", "confidence")], *cols)


def summary_rows(extracted: DataFrame, key: str = "source_file") -> DataFrame:
    """Extracted fields as rows of the summary table: preferred fee first, a valid risk class only, the ESG signs together, plan eligibility from the legal form; N/A where nothing is known."""
    c, na = F.col, F.lit("N/A")
    risk = F.regexp_extract(F.coalesce("sri", "srri", F.lit("")), r"^([1-7])(?:\D|$)", 1)
    article = F.regexp_extract(F.coalesce("classification_sfdr", F.lit("")), r"([689])", 1)
    esg = F.concat_ws(" / ", c("approche_esg"), F.when(c("investissements_durables_min").isNotNull(), F.concat(F.lit("durable "), c("investissements_durables_min"))))
    saving = F.when(c("forme_juridique") == "FCPE", "oui")
    cols = {
        "source_file": c(key), "fonds": c("nom_produit"), "isin": c("isin"), "code_fonds": c("identifiant"), "societe_gestion": c("societe_gestion"), "structure": F.coalesce("forme_juridique", "type_produit"),
        "categorie": c("classification"), "benchmark": c("indice_reference"), "devise": c("devise"), "depositaire": c("depositaire"), "horizon_recommande": c("periode_detention"),
        "sfdr_article": F.nullif(article, F.lit("")), "priips_sri": F.nullif(risk, F.lit("")), "esg_estime": F.nullif(esg, F.lit("")), "pee": saving, "perco": saving,
        "frais_entree_max": c("commission_souscription"), "frais_gestion_annuels": F.coalesce("frais_courants", "frais_gestion", "frais_fonctionnement"), "frais_sortie": c("commission_rachat"),
        "commission_surperformance": c("commission_surperformance"),
    }
    return extracted.select(*[F.coalesce(v.cast("string"), na).alias(n) for n, v in cols.items()])
