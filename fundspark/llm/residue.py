"""Template residue, filler copy, error pages and script notices in documents.

Words in four languages are found by one multi-pattern automaton over the
folded text. A sentence or line is residue when the lexicon covers nearly all
of it and its words play the right parts (a thing and its failure, scripts and the wish for them ...);
fields of templates are found by the forms of the common template
languages. Each document gets the kinds found and the share of its text that
they cover; a document is excluded when that coverage exceeds a threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pyarrow as pa

# Words by the part they play, lower case, without accents, in en, fr, de, es; a word that ends in * stands for all that begin so.
LEXICON = {
    # things that a site's messages are about
    "thing": """
        page pages site website document file folder url link address resource content service server database data session certificate connection request account
        access app application system gateway host network operation load loading download upload form id login password something looking requests problem issue cookie cookies chart image video domain
        fichier dossier lien adresse ressource contenu serveur cherchez delai attente requetes probleme base donnees certificat connexion requete compte acces operation chargement formulaire graphique appel systeme
        seite seiten datei adresse inhalt inhalte dienst server datenbank sitzung zertifikat verbindung anfrage konto zugriff anwendung vorgang laden diagramm bild anfragen problem
        pagina sitio documento archivo enlace direccion recurso contenido servicio servidor datos sesion certificado conexion solicitud cuenta acceso aplicacion operacion carga grafico solicitudes problema
    """,
    # what by itself says that something failed
    "fault": """
        error* unavailable timed denied refused forbidden unauthorized expired timeout failed failure fail fails unreachable missing lost wrong aborted interrupted removed deleted moved
        corrupted unexpected internal invalid blocked disabled down broken offline maintenance oops technical
        erreur* indisponible* introuvable* refuse* interdit* expire* depasse* echec* injoignable* absente absent perdue interrompu* retire* supprime* deplacee* inattendu* interne
        invalide bloque* desactive* incident technique maintenance impossible
        fehler* verweigert verboten abgelehnt abgelaufen zeituberschreitung fehlgeschlagen unerreichbar unterbrochen entfernt geloscht unerwarteter unbekannt ungultig gesperrt blockiert* deaktiviert
        wartung storung technische verschoben
        errores indisponible denegad* prohibid* caducad* agotad* fallo fallid* perdida interrumpid* retirad* eliminad* inesperad* desconocid* bloquead* desactivad* mantenimiento incidencia
        tecnica roto
    """,
    # what says so when it is denied, or too much
    "if_denied": """
        found available respond* responding working work works exist exists match* allowed permission permissions rights authorized supported support able displayed shown reach* requests gateway long
        trouve* disponible* repond* fonctionne* existe* correspond* droits autorisation habilite* autorise* affiche* affiché* demandee requetes prend charge
        gefunden verfugbar antwortet funktioniert existiert berechtigung berechtigt rechte erreichbar anfragen angezeigt erlaubt
        encontrad* disponible responde funciona existe corresponde permiso permisos puede solicitudes mostrar
    """,
    "denial": """
        not no cannot can't couldn't don't doesn't isn't wasn't aren't haven't hasn't unable any too lacks without bad never
        pas ne n n'a n'avons n'avez n'est n'existe n'ont aucun* aucune plus trop sans
        nicht kein* zu
        no ningun* demasiad* sin nunca
    """,
    # what the reader is asked to do, and courtesies
    "request": """
        try again retry reload refresh please contact sorry slow thank thanks patience apologi* later return back home wait administrator webmaster support helpdesk quote check checking verify verifying human robot moment
        reessay* recharg* rafraich* actualisez veuillez merci desole* contactez patient* revenez accueil administrateur assistance plus tard reconnecter verifiez verification instants humain
        versuchen erneut neu aktualisieren bitte leid entschuldig* spater wenden kontaktieren zuruck startseite geduld uberprufen uberprufung
        intentelo intente recargue actualice por favor sentimos disculp* tarde vuelva inicio contacte soporte paciencia revise compruebe
    """,
    "script": """
        javascript js script scripts scripting cookies dynamic active code content browser
        dynamique* actif contenu navigateur execution
        skript skripte skripts aktive inhalte browser
        activo contenido dinamico ejecucion navegador
    """,
    # asking for scripts, or saying that they are missing
    "switch": """
        enable* allow* activate* unblock* turn need* require* accept* lift disabled blocked support supported run switch
        activ* autoris* debloqu* necessit* accept* levez levee desactive* bloque* requiert besoin
        aktivier* erlaub* schalten einschalten zulassen freigeben benotig* erforder* brauch* deaktiviert blockier*
        habilit* permit* desbloque* requier* necesit* activ* acept* bloquead*
    """,
    # copy that stands for copy, strong alone
    "filler": """
        placeholder dummy blindtext* mustertext* platzhalter* beispieltext* beispielabsatz lipsum
        remplissage fictif fictive ficticio ficticia bla test sample specimen
    """,
    # copy that is asked for: what, where, and to do what with it
    "copy": """
        text copy comment paragraph title subtitle heading headline content description layout
        texte commentaire paragraphe titre sous-titre intertitre maquette exemple
        text kommentar absatz titel untertitel uberschrift layout beispiel
        texto comentario parrafo titulo subtitulo maquetacion muestra
    """,
    "title": "title titre titel titulo",
    "here": "here ici hier aqui",
    "put": """
        insert enter type replace* fill add goes write put publish* publication
        inser* saisi* remplac* ajoute* ecri* complet* diffuser publier publication
        einfug* eingeben ersetz* erganz* steht schreib* veroffentlich*
        insert* escrib* reemplaz* sustitu* publicar
    """,
    "todo": """
        filled completed confirmed defined supplied renseign* complet* precis* confirm* defini* ausfull* auszufullen erganzen erganz* rellenar completar confirmar definir
    """,
    # words that carry none of this
    "plain": """
        a an the this that these those it its is are was were be been being has have had do does did will would should must may might i we you your our my us they he she one on in at to of for from by with
        and or but if when while as so before after about into again more most very just only also now then there what which who us can could let read see view open show display displayed continue
        continuing using use visit visiting requested required currently temporarily many often settings set establishing time took went go goes down up out in order
        le la les l un une des de du d au aux a en et ou est sont ete etre avoir avez avons avait ont se ce cette ces cet son sa ses nous vous votre vos notre nos je il elle que qu' qui quoi si rien
        pour par sur dans avec avant apres afin lors moment temps momentanement demande* demandee saisie en cours code destine montrer mise suite lire voir ouvrir charger afficher continuer
        consulter poursuivre necessaires ici jusqu' quelques tout toute toutes tous fois s'est s'affiche survenue survenu modifiez reglages essayer sommes identifiant ce peut peuvent est-ce espace client fiche fonds fond performance
        der die das den dem des ein eine einen einem einer sein ist sind war wird werden wurde wurden hat haben muss mussen kann konnen sie ihr ihre ihren wir uns es er um zu zum zur in im an am auf aus bei mit nach
        von vor und oder aber wenn weil da derzeit wegen damit diese dieser dieses fur als auch nur noch sehr lange fortzufahren anzeigen anzuzeigen sehen geladen fondsseite aufgetreten angeforderte anzeige ein derzeit support
        el la los las un una unos unas de del al a y o en es son ha han sido se su sus lo le nos usted que por para con sin esta este esto estos como cuando si ya muy mas debe ser ver cargar continuar momento
        fondo fondos ficha producido solicitada gestor manager's gerant fund sheet fund's area client part grafico para mi
        to-do text: ref trace id incident-id patience s t re y'a c'est d'un d'une qu'il l'on jusqu'a
    """,
}
# Words of the usual Latin filler.
LATIN = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi
aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim
id est laborum perspiciatis unde omnis iste natus error voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis quasi architecto beatae vitae dicta explicabo
nemo ipsam quia voluptas aspernatur aut odit fugit consequuntur magni dolores eos ratione sequi nesciunt neque porro quisquam dolorem numquam eius modi tempora incidunt magnam aliquam quaerat"""
#: Words of Latin filler in a sentence that make it filler copy.
LATIN_WORDS = 4
#: Share of the words of a sentence or line, of any length, that must be of the lexicon for it to be residue.
UNIT_COVERAGE = 0.85

# Forms of template fields; each begins with its own sign.
FIELDS = (
    r"\{\{[^{}\n]+\}\}",
    r"\{%[^%\n]+%\}",
    r"<%[^%\n]+%>",
    r"\$\{[^{}\n]+\}",
    r"\[\[[^\[\]\n]+\]\]",
    r"@@[\w.]+@@",
    r"__(?<!\w__)[^\W\d_](?:[\w.]*[^\W_])?__(?!\w)",
    r"_(?<!\w_)_{4,}(?!\w)",
    r"#(?<!\w#)[A-Z][A-Z_.]+#",
    r"#(?:N/A|REF!|VALUE!|VALEUR!|DIV/0!|NAME\?|NOM\?|NUM!|NULL!)",
    r"%(?<![\w%]%)[A-Z][A-Z_.]+%(?!\w)",
    r"\$(?<!\w\$)[A-Z][A-Z_]{2,}\b",
    r"&&\w+;",
    r"«[^\W\d_][\w.]{2,40}»",
    r"<(?!(?:br|hr|img|input|meta|link|wbr)\b)[^\W\d_][\w.]*/>",
    r"<(?!/?(?:html|head|body|title|h\d|hr|br|p|div|span|a|b|i|u|em|strong|small|sup|sub|ul|ol|li|table|tr|td|th|thead|tbody|pre|code|noscript|script|style|img|form|input)\b)[^\W\d_][^<>\n|=;/\d]{2,40}>",
    r"\[(?:[●•]|(?!sic\]|ndlr\]|NDLR\]|note\])[^\W\d_][^\[\]\n\d]{2,40})\]",
    r"\{(?<![\w^\\]\{)(?:\d|[^\W\d_][^{}\n,;=]{2,40})\}",
    r"\.\.{9,}+(?!\s*\d+\s*(?:\n|$))",
    r"%\([A-Za-z_]\w*\)[sdif]",
)

# Words that stand where a value failed to be filled in, as they are written.
FAILED = """TBD TBC NaN undefined JJ/MM/AAAA DD/MM/YYYY MM/DD/YYYY DD/MM/AAAA YYYY-MM-DD AAAA-MM-JJ TT.MM.JJJJ
dd/mm/yyyy jj/mm/aaaa xxxx XX,XX XX.XX"""

# The head of an error page, at the start of a line or sentence.
HEADS = r"(?:^|[\n>.!?…|]\s*)(?:erreur|error|fehler|http)(?: code)? [45]\d\d\s*(?:$|[:.,!…\n<–-])"

_HEAD_WORDS = ("erreur", "error", "fehler", "http")

RESULT = "doc_id bigint, kinds array<string>, matched int, coverage double"


def fold(text: str) -> str:
    """Lower case without accents and with plain apostrophes and blanks, of the same length as ``text``."""
    return text.translate(_folding()).lower() if not text.isascii() else text.lower()


class _Folding(dict):
    """Character by character, filled as characters come up."""

    def __missing__(self, code: int) -> str:
        import unicodedata

        c = chr(code)
        out = "'" if c in "’ʼ`´" else " " if c.isspace() and c not in "\n\r\t" else unicodedata.normalize("NFD", c)[0]
        self[code] = out if len(out.lower()) == 1 else c
        return self[code]


def _cached(make):
    kept = []

    def get():
        if not kept:
            kept.append(make())
        return kept[0]

    return get


_folding = _cached(_Folding)

#: Parts whose words make a sentence worth looking at.
_TRIGGERS = ("fault", "if_denied", "request", "switch", "filler", "title", "here", "put", "todo")
_LATIN_KIND = "latin"


def _build():
    """The automaton of all words that may begin residue, and the parts of whole words and of beginnings of words."""
    import ahocorasick

    whole: dict[str, set] = {}
    begin: dict[str, set] = {}
    for part, words in LEXICON.items():
        for w in words.split():
            (begin if w.endswith("*") else whole).setdefault(w.rstrip("*"), set()).add(part)
    for w in LATIN.split():
        whole.setdefault(w, set()).add(_LATIN_KIND)
    a = ahocorasick.Automaton()
    for table, exact in ((whole, True), (begin, False)):
        for w, parts in table.items():
            if parts.intersection(_TRIGGERS) or _LATIN_KIND in parts and len(w) > 4:
                a.add_word(w, (len(w), exact or w in whole and w not in begin, None))
    for word in FAILED.split():
        a.add_word(word.lower(), (len(word), True, word.lower()))
    a.make_automaton()
    return a, {w: frozenset(p) for w, p in whole.items()}, {w: frozenset(p) for w, p in begin.items()}


_lexicon = _cached(_build)


class _Parts(dict):
    """Word to the parts it plays, filled as words come up."""

    def __missing__(self, word: str) -> frozenset:
        _, whole, begin = _lexicon()
        out = set(whole.get(word, ()))
        for n in range(3, len(word) + 1):
            out |= begin.get(word[:n], frozenset())
        if not out and "'" in word:  # an elided article or pronoun
            out = set(self[word.split("'", 1)[1]])
        if len(self) > 200_000:
            self.clear()
        self[word] = frozenset(out)
        return self[word]


_parts = _cached(_Parts)


def unit_kind(unit: str) -> str:
    """The kind of residue that a folded sentence or line is by the parts of its words, or ''.

    Nearly all words must be of the lexicon, so that a sentence which tells of such
    things (whose, when, with what consequence) is none.
    """
    parts = _parts()
    words = [w.strip("'") for w in _word().findall(unit)]
    seen = [parts[w] for w in words if not any(c.isdigit() for c in w)]
    n = len(seen)
    if not n or sum(1 for p in seen if p) < UNIT_COVERAGE * n:
        return ""
    count = {k: sum(k in p for p in seen) for k in ("thing", "fault", "if_denied", "denial", "request", "script", "switch", "filler", "copy", "here", "put", "todo", _LATIN_KIND)}
    if count[_LATIN_KIND] >= LATIN_WORDS and count[_LATIN_KIND] >= UNIT_COVERAGE * n:
        return "filler"
    strong = sum("filler" in p for p in seen)
    if strong and (count["copy"] or count["here"] or count["put"]) or strong >= 3 and strong == n or strong and n == 1 and words[0] not in ("test", "bla", "sample", "specimen"):
        return "filler"
    if count["copy"] and (count["here"] and n <= 8 or count["put"] and (count["denial"] or count["here"] or words[0] in _OPENERS or "a" in words[1:-1])) or count["copy"] and n <= 4 and "title" in seen[0] and count["thing"]:
        return "filler"
    fails = count["fault"] or count["if_denied"] and count["denial"]
    if count["script"] and count["switch"]:
        return "script"
    if fails and (count["thing"] or count["request"] or count["fault"] >= 2):
        return "error"
    if count["request"] >= 2 and n >= 2 and (count["thing"] or count["request"] >= 0.4 * n):
        return "error"
    return "error" if count["request"] and count["thing"] and n <= 5 and parts[words[0]] & {"request"} else ""


# What opens a request to put copy somewhere.
_OPENERS = ("insert", "enter", "type", "replace", "inserez", "saisissez", "remplacez", "bitte", "inserte", "escriba", "texte", "text", "texto")
# What stands in brackets where a value is still to come.
_TODO = r"[(\[](?:a|to be|noch|bitte|por|a ser)\s[^()\[\]\n]{3,30}[)\]]"


def residue_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every residue in ``text``; kinds: field, filler, script, error.

    The automaton finds the words that may begin residue; the sentence or line around each is judged once by the share and parts of its words.
    """
    import re

    low = fold(text)
    automaton, _, _ = _lexicon()
    spans, until = [], -1
    n = len(low)
    ends = None
    for end, (size, exact, failed) in automaton.iter(low):
        start, stop = end - size + 1, end + 1
        if start and low[start - 1].isalnum() and low[start].isalnum():
            continue
        if failed:
            if failed == "xxxx":  # any number of them
                stop += next((k for k, c in enumerate(text[stop:]) if c != "x"), n - stop)
            if text[start : start + size] in _failed() and (stop == n or not low[stop].isalnum() or not low[stop - 1].isalnum()):
                spans.append((start, stop, "field"))
            continue
        if start < until or exact and stop < n and low[stop].isalnum():
            continue
        if ends is None:
            ends = [0, *(m.end() for m in _edge().finditer(low)), n]
            at = 0
        while ends[at + 1] <= start:
            at += 1
        a, b = ends[at], ends[at + 1]
        until = b
        kind = unit_kind(low[a:b])
        if kind:
            spans.append((a, b, kind))
    spans += [(m.start(), m.end(), "field") for m in _field().finditer(text)]
    if any(w in low for w in _HEAD_WORDS):
        spans += [(m.start(), m.end(), "error") for m in _head().finditer(low)]
    if "(" in low or "[" in low:
        spans += [(m.start(), m.end(), "field") for m in _todo().finditer(low) if any("todo" in _parts()[w] for w in _word().findall(m.group()))]
    return spans


def _compiled(pattern: str):
    import re

    return re.compile(pattern)


_failed = _cached(lambda: frozenset(FAILED.split()))
_field = _cached(lambda: _compiled("|".join(FIELDS)))
_head = _cached(lambda: _compiled(HEADS))
_todo = _cached(lambda: _compiled(_TODO))
_word = _cached(lambda: _compiled(r"[^\W_]+(?:['-][^\W_]+)*"))
# sentences, lines, cells and what stands between tags
_edge = _cached(lambda: _compiled(r"[.!?…]+(?=\s|$|<)\s*|[\n\r|<>]+\s*"))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow as pa

    for batch in batches:
        kinds, matched, share = [], [], []
        known: dict[str, tuple] = {}
        for text in batch.column(1).to_pylist():
            got = known.get(text) if text else ([], 0, 0.0)
            if got is None:
                spans = sorted(residue_spans(text))
                covered, until = 0, 0
                for a, b, _ in spans:
                    covered += max(0, b - max(a, until))
                    until = max(until, b)
                got = known[text] = (sorted({k for _, _, k in spans}), covered, round(covered / len(text), 6))
            kinds.append(got[0])
            matched.append(got[1])
            share.append(got[2])
        yield pa.record_batch(
            [batch.column(0), pa.array(kinds, pa.list_(pa.string())), pa.array(matched, pa.int32()), pa.array(share, pa.float64())],
            names=["doc_id", "kinds", "matched", "coverage"],
        )


def residue(docs: DataFrame) -> DataFrame:
    """(doc_id, kinds, matched, coverage) of each row of ``docs`` (doc_id, text; other columns are dropped).

    Whole texts in one pass without a shuffle, equal texts of a batch once. A null or empty text has no kinds and coverage 0; every row gives one row.
    """
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_judge, RESULT)


def marked(docs: DataFrame, min_coverage: float = 0.0) -> DataFrame:
    """``residue`` with ``excluded``: whether the coverage exceeds ``min_coverage`` (0: any residue anywhere excludes)."""
    return residue(docs).withColumn("excluded", F.col("coverage") > min_coverage)
