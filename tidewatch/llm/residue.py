"""Template residue and error pages: labelled exemplars, an inverted index, TF-IDF containment.

Texts become terms: folded words, where nouns for what a page or a subtitle file shows are one term; one
term for any number, path, host or code; and one per form of unfilled place, such as braces around a name.
Exemplars are stock phrases of web servers, frameworks and template languages, as terms. Passages are a
document's cues (text outside cues: its lines), lines of a cue and runs of adjacent lines, over cues too, of
at most an exemplar's length, and, for unfilled places, single terms. An inverted index over the exemplars'
terms retrieves the exemplars a passage may hold: those of whose TF-IDF weight it has a good part. A passage
is residue if the exemplars it holds contain most of its weight. Document frequencies are counted over all
documents, in the same terms. The filler exemplar is a bag of words, as fillers draw them in any order; words
that in the whole collection stand mostly beside words of the bag join it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from http import HTTPStatus

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.subtitles import LINE_ENDS, fold

#: Forms of unfilled places, by the template languages that have them; fixed values.
PLACE_FORMS = {
    "mustache": r"\{\{[^{}\n]*\}\}", "jinja": r"\{%[^%\n]*%\}", "shell": r"\$\{[^{}\n]*\}", "ruby": r"#\{[^{}\n]*\}", "erb": r"<%[^%\n]*%>", "wiki": r"\[\[[^\[\]\n]*\]\]", "chevrons": r"<<[^<>\n]+>>", "batch": r"%[A-Z][A-Z0-9_]+%",
    "dollars": r"\$[A-Z][A-Z0-9_]*\$", "dunder": r"__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__", "ats": r"@@[A-Z0-9_]+@@", "printf": r"%\(\w+\)[sdf]", "index": r"\{\d+\}(?!\{\d)", "brace": r"\{ ?(?!an?\d)[A-Za-z]\w+(?:\.\w+)* ?\}",
    "angle": r"<(?!(?i:TAGS)\b)(?:[A-Z]{3,}|[A-Za-z]+(?:[ _-]+[A-Za-z0-9]+)+)>",
}
#: Elements of HTML, WebVTT and TTML; fixed values.
TAGS = "a|abbr|article|aside|audio|b|big|blockquote|body|br|button|c|center|cite|code|dd|del|div|dl|dt|em|font|footer|form|h[1-6]|head|header|hr|html|i|iframe|img|input|ins|lang|li|link|main|meta|nav|ol|option|p|pre|rp|rt|ruby|s|script|section|select|small|span|strike|strong|style|sub|sup|svg|table|tbody|td|textarea|th|thead|title|tr|tt|u|ul|v|video"
PLACE = re.compile("|".join(f"(?P<{name}>{form})" for name, form in PLACE_FORMS.items()).replace("TAGS", TAGS))
#: Where a place can begin.
OPENS = re.compile(r"[{\[<%$#_@]")
NUMBER_LINE = re.compile(r"^\W{0,3}\d+\W{0,2}$")
#: Markup that isn't text.
CODES = re.compile(r"\{\\[^{}\n]*\}|\{[a-zA-Z]:[^{}\n]*\}|</?(?i:TAGS)\b(?!_)[^<>\n]*>|</[^<>\n]*>|<(?![%<])[^<>=\n]*=[^<>\n]*>|<![^<>\n]*>|<[a-zA-Z]>".replace("TAGS", TAGS))
#: Paths, chains of words and dots, codes and numbers.
SPECIAL = re.compile(r"(?P<path>\"?(?<!\w)/[\w./-]+\"?)|(?P<chain>\w[\w-]*+(?:\.[\w-]++)++)|\b(?P<code>(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{4,}\b|\d+)")
VALUE, THING, CROSSES = "=value", "=thing", "=crosses"
#: Nouns for what a page or a subtitle file is or shows, which stock phrases exchange; fixed values.
THINGS = "page pages site website app application file files document content link url address resource text title subtitle subtitles caption captions line cue cues dialogue página sitio archivo documento contenido enlace dirección texto título subtítulo subtítulos línea fichier document contenu lien adresse texte titre sous-titre sous-titres ligne seite webseite anwendung datei inhalt adresse titel untertitel zeile"


#: Labelled exemplars: reason phrases of HTTP, default pages of web servers and proxies, messages of web frameworks and
#: content systems with their usual translations, leftovers of editors and localisation files; fixed values.
EXEMPLARS: dict[str, tuple[str, ...]] = {
    "unfilled place": ("{{name}}", "{% name %}", "${name}", "#{name}", "<%= name %>", "[[NAME]]", "<<name>>", "%NAME%", "$NAME$", "__NAME__", "@@NAME@@", "%(name)s", "{0}", "{name}", "<FULL NAME>"),
    "placeholder": (
        "undefined", "[object Object]", "TODO translate", "TBD", "FIXME", "to be announced", "to be translated", "translate this", "untranslated", "not translated", "translation missing", "missing translation", "translation goes here", "translation here", "your text here", "text goes here", "insert text here", "insert name here", "insert name", "insert your text", "add your text", "enter text here", "type your text here",
        "placeholder text", "placeholder", "tu texto aquí", "escribe tu texto aquí", "inserte el texto aquí", "texto de relleno", "sin traducir", "traducción pendiente", "votre texte ici", "insérez votre texte ici", "texte à traduire", "non traduit", "hier Text eingeben", "hier Text einfügen", "Ihr Text hier", "nicht übersetzt", "Platzhalter",
    ),
    "filler": ("lorem ipsum", "sample text", "dummy text", "test text please ignore", "this is a test, please ignore", "filler text", "text text text", "test test test", "bla bla bla bla", "blah blah blah blah", "asdf asdf", "asdf jkl", "qwerty qwerty", "foo bar baz", "xxx xxx", "xxx xxx xxx", "texto de ejemplo", "texto de prueba", "texte d'exemple", "Beispieltext", "Blindtext"),
    "error page": (
        *(f"{s.value} {s.phrase}" for s in HTTPStatus if s >= 400), *(s.description for s in HTTPStatus if s >= 400 and s.description), "Error 404", "HTTP error 500", "code 12", "Request ID: 12", "Reference #12", "The requested URL /a was not found on this server.", "Page not found", "The page you are looking for does not exist", "Access denied", "You don't have permission to access /a on this server.",
        "The server encountered an internal error and was unable to complete your request.", "Bad gateway", "Gateway timeout", "Web server is down", "Service unavailable", "The service is temporarily unavailable", "Fatal error: Uncaught Exception in /a on line 1", "Warning: undefined variable in /a on line 1", "Parse error: syntax error in /a on line 1", "Oops! Something went wrong.", "Something went wrong while loading this page", "Try again later.", "Try reloading the page", "Go back to the homepage",
        "Sorry, this page has been removed", "This link has expired", "The file has expired or been deleted", "Your session has expired", "Session timed out", "Please log in again", "Log in to download", "Too many requests", "You have reached your limit for today", "You have reached the download limit", "Try again in 1 minutes", "The site is down for maintenance", "The site is undergoing scheduled maintenance", "We will be back shortly", "Check back in a minute",
        "Página no encontrada", "Error 404: no se encontró la página", "La página solicitada no existe en este servidor", "Acceso denegado", "No tiene permiso para acceder", "Su sesión ha caducado", "La sesión ha expirado", "Error interno del servidor", "Inténtalo de nuevo más tarde", "Servicio no disponible", "Has superado el límite de descargas", "Has alcanzado el límite diario", "Límite de descargas diarias", "Volveremos pronto", "Sitio en mantenimiento",
        "Page introuvable", "Page non trouvée", "La page demandée n'existe pas sur ce serveur", "Accès refusé", "Accès interdit", "Votre session a expiré", "Erreur interne du serveur", "Réessayez plus tard", "Veuillez réessayer plus tard", "Service indisponible", "Vous avez dépassé la limite de téléchargements", "Site en maintenance",
        "Seite nicht gefunden", "Die angeforderte Seite existiert auf diesem Server nicht", "Zugriff verweigert", "Ihre Sitzung ist abgelaufen", "Interner Serverfehler", "Bitte versuchen Sie es später erneut", "Dienst nicht verfügbar", "Sie haben das Limit erreicht", "Wegen Wartungsarbeiten nicht erreichbar",
        "Pagina non trovata", "Accesso negato", "Errore interno del server", "Riprova più tardi", "Página não encontrada", "Acesso negado", "Erro interno do servidor", "Tente novamente mais tarde", "Pagina niet gevonden", "Toegang geweigerd",
    ),
    "script notice": (
        "Enable JavaScript and cookies to continue", "Please enable JavaScript to continue using this application.", "You need to enable JavaScript to run this app.", "We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.", "JavaScript is required to view this page", "JavaScript is disabled in your browser", "Your browser does not support JavaScript", "Your browser does not seem to support scripts", "This site works best with JavaScript enabled",
        "For full functionality of this site it is necessary to enable JavaScript.", "Please turn on JavaScript in your browser", "You need to have JavaScript turned on in your browser to view this page", "Enable scripts to continue", "Scripts must be turned on to run this page", "Checking your browser before accessing a.example", "Please allow cookies", "DDoS protection", "Verify you are human",
        "Activa JavaScript en tu navegador", "Debes habilitar JavaScript para ver esta página", "Debes activar JavaScript para ver este sitio", "Este sitio requiere JavaScript", "Veuillez activer JavaScript dans votre navigateur", "Veuillez activer JavaScript pour continuer", "Activez JavaScript pour afficher ce site", "JavaScript est nécessaire pour afficher cette page", "Bitte aktivieren Sie JavaScript in Ihrem Browser", "Um diese Seite anzuzeigen, wird JavaScript benötigt", "Diese Seite benötigt JavaScript",
        "Abilita JavaScript per continuare", "Ative o JavaScript para continuar", "Schakel JavaScript in om door te gaan",
    ),
}
#: The words of the standard lorem ipsum, of its source (Cicero, De finibus 1.32 f.) and of its common generators; fixed values.
LOREM = (
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat "
    "duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum "
    "perspiciatis unde omnis iste natus error voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis quasi architecto beatae vitae dicta explicabo nemo ipsam quia voluptas aspernatur aut odit fugit consequuntur magni dolores eos ratione sequi nesciunt neque porro quisquam dolorem adipisci numquam eius modi tempora incidunt magnam aliquam quaerat "
    "minima nostrum exercitationem ullam corporis suscipit laboriosam aliquid commodi consequatur autem vel eum iure quam nihil molestiae illum quo at vero accusamus iusto odio dignissimos ducimus blanditiis praesentium voluptatum deleniti atque corrupti quos quas molestias excepturi occaecati cupiditate provident similique mollitia animi dolorum fuga harum quidem rerum facilis expedita distinctio nam libero tempore cum soluta nobis eligendi optio cumque impedit minus quod maxime placeat facere possimus assumenda repellendus temporibus quibusdam officiis debitis necessitatibus saepe eveniet voluptates repudiandae recusandae itaque earum hic tenetur sapiente delectus reiciendis voluptatibus maiores alias perferendis doloribus asperiores repellat "
    "a ac accumsan aenean aliquet ante aptent arcu auctor augue bibendum blandit class condimentum congue conubia convallis cras cubilia curabitur curae cursus dapibus diam dictum dictumst dignissim dis donec dui efficitur egestas eget eleifend elementum erat eros etiam euismod facilisi facilisis fames faucibus felis fermentum feugiat finibus fringilla fusce gravida habitant habitasse hac hendrerit himenaeos iaculis imperdiet inceptos integer interdum justo lacinia lacus laoreet lectus leo ligula litora lobortis luctus maecenas malesuada massa mattis mauris maximus metus mi molestie mollis montes morbi mus nam nascetur natoque nec netus nibh nisl nullam nunc odio orci ornare parturient pellentesque penatibus per pharetra phasellus placerat platea porta porttitor posuere potenti praesent pretium primis proin pulvinar purus quisque rhoncus ridiculus risus rutrum sagittis sapien scelerisque sem semper senectus sociis sociosqu sodales sollicitudin suscipit suspendisse taciti tellus tempus tincidunt torquent tortor tristique turpis ullamcorper ultrices ultricies urna varius vehicula vel venenatis vestibulum vivamus viverra volutpat vulputate"
)
#: Words of LOREM that other languages have; they count towards a filler's share, but two words beside them must be there. Fixed values.
COMMON = "a ab ac ad alias ante at aut class cum diam dis do dui ea error est et eu ex fuga hac hic id in integer leo mi minus minima modi mus nam nec nobis non per porta quam quasi qui quo quos quas rem sed sem sequi sint tempo tempora unde ut varius vel error maxime massa minim quae quia sunt esse vero nulla urna justo"
#: Share of an exemplar's weight a passage must have, by kind; messages vary more than fillers and places do.
HELD = {"error page": 0.5, "script notice": 0.5}
#: A word joins the filler's bag if it stands beside at least so many different words of it, in at least so many documents,
#: which are at least such a share of the documents that have the word.
BESIDE, SUPPORT, SHARE = 3, 3, 0.5
#: Share of a filler's words and of their weight that the bag must have.
BAG_INSIDE = 0.85
#: Words that join are sent to the tasks; more are refused.
MOST_JOINED = 200_000
FLUSH = 500_000

_THINGS = {w: THING for thing in THINGS.replace("-", " ").split() for w in fold(thing).split()}


def _words(text: str) -> list[str]:
    """Folded words; nouns for things, and words of nothing but the letter x, are one term each."""
    ws = [_THINGS.get(w, w) for w in fold(text).split()]
    return [w if len(w) < 3 or w.strip("x") else CROSSES for w in ws] if "xxx" in text.lower() else ws


def terms(text: str) -> list[str]:
    """The terms of a text without markup."""
    out: list[str] = []
    at = 0
    for start, end, form in places(text):
        out += _plain(text[at:start])
        out.append(form)
        at = end
    return out + _plain(text[at:])


def _plain(text: str) -> list[str]:
    out: list[str] = []
    at = 0
    for m in SPECIAL.finditer(text):
        if m.lastgroup == "chain":
            last = m["chain"].rpartition(".")[2]
            if not (len(last) > 1 and last.islower() and last.isascii()):
                continue  # words without a blank between sentences
        out += _words(text[at : m.start()])
        out.append(VALUE)
        at = m.end()
    return out + _words(text[at:])


def places(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and form of each unfilled place."""
    end = 0
    for m in OPENS.finditer(text):
        if m.start() >= end and not (m[0] == "{" and m.start() and text[m.start() - 1] == "}"):
            p = PLACE.match(text, m.start())
            if p:
                end = p.end()
                yield p.start(), end, "=" + p.lastgroup


def units(text: str) -> Iterator[list[str]]:
    """The lines of each cue of a text, without markup; outside cues, each line. Unfilled places are kept."""
    if "\r" in text:
        text = LINE_ENDS.sub("\n", text)
    if "<" in text or "{" in text:
        text = CODES.sub(" ", text)
    if "&" in text:
        text = html.unescape(text).replace("\r", "\n")
        if "<" in text:
            text = CODES.sub(" ", text)
    text = text.lstrip("﻿")
    cue: list[str] = []
    timed = False
    for line in text.split("\n"):
        if "-->" in line:
            while cue and NUMBER_LINE.match(cue[-1]):
                cue.pop()
            if cue:
                yield from [cue] if timed else ([c] for c in cue)
            cue, timed = [], True
        elif not line.strip():
            if timed and cue:
                yield cue
                cue, timed = [], False
        elif line.strip() not in ("WEBVTT",):
            cue.append(line.strip())
    if cue:
        yield from [cue] if timed else ([c] for c in cue if not NUMBER_LINE.match(c))


def passages(text: str) -> Iterator[str]:
    """The cues of a text; outside cues, its lines."""
    return (" ".join(lines) for lines in units(text))


def apart(before: str, after: str) -> bool:
    """Whether a sentence may end between two lines of a cue."""
    return not (after[0].islower() and (before[-1].isalnum() or before[-1] in ",;-"))


@dataclass
class Index:
    """Exemplars' terms with their weights and the postings of each term."""

    weight: dict[str, float]
    unknown: float
    exemplars: list[tuple[str, Counter, float, float]]
    postings: dict[str, list[int]]
    bag: frozenset
    common: frozenset
    needed: frozenset
    longest: int
    forms: frozenset
    known: frozenset

    @classmethod
    def build(cls, frequency: dict[str, int], documents: int, exemplars: dict[str, Sequence[str]] | None = None, bag: Sequence[str] = (), held: float = 0.8) -> "Index":
        """``frequency`` has the number of documents with a term; ``bag`` are words of the filler besides the standard ones."""
        counted = [(kind, Counter(terms(e))) for kind, texts in (exemplars or EXEMPLARS).items() for e in texts]
        words = frozenset(_words(LOREM)) | frozenset(bag)
        named = {t for _, c in counted for t in c}
        weight = {t: math.log((documents + 1) / (frequency.get(t, 0) + 1)) + 0.5 for t in named | words}
        weight[VALUE] = 0.5
        usual = sorted(weight[t] for t in named)
        postings: dict[str, list[int]] = defaultdict(list)
        rows, needed, forms = [], set(), set()
        for k, (kind, c) in enumerate(counted):
            whole, share = sum(weight[t] * n for t, n in c.items()), HELD.get(kind, held)
            rows.append((kind, c, whole, share))
            for t in c:
                postings[t].append(k)
            if len(c) == 1 and next(iter(c)).removeprefix("=") in PLACE_FORMS:
                forms |= set(c)
            # without any of its heaviest terms a passage can't have enough of the exemplar
            left = whole
            for t in sorted(c, key=lambda t: (-weight[t] * c[t], t)):
                needed.add(t)
                left -= weight[t] * c[t]
                if left < share * whole:
                    break
        common = frozenset(_words(COMMON))
        return cls(weight, max(4.0, usual[len(usual) // 2]) if usual else 4.0, rows, dict(postings), words, common, _as_written(frozenset(needed) | (words - common)), max((sum(c.values()) for _, c in counted), default=0), frozenset(forms), _as_written(frozenset(named) | words))


def _as_written(found: frozenset) -> frozenset:
    """With the folded words that a term stands for."""
    return found | frozenset(_THINGS) if THING in found else found


def vocabulary(exemplars: dict[str, Sequence[str]] | None = None) -> set[str]:
    return {t for texts in (exemplars or EXEMPLARS).values() for e in texts for t in terms(e)} | set(_words(LOREM))


def of_text(text: str, index: Index, inside: float = 0.75) -> Counter:
    """Kinds of residue in a text, with the number of passages of each.

    A passage without any term that some exemplar can't do without, or with more than half its words in no
    exemplar, holds none; only the others are judged in full. Of units that aren't residue as a whole,
    single lines of a cue and runs of lines are judged likewise, if no sentence of the cue goes on beyond
    them. Each line of a run must have half its words in exemplars.
    """
    got: Counter = Counter()
    cut = list(units(text))
    lines = [line for unit in cut for line in unit]
    whole = "\n".join(lines)
    folded = fold(whole)
    placed = OPENS.search(whole) is not None
    needed, known = index.needed, index.known
    if not placed and "xxx" not in folded and needed.isdisjoint(folded.split()):
        return got
    words = [line.split() if "xxx" not in line else _words(line) for line in folded.split("\n")]
    hits = [i for i, ws in enumerate(words) if not needed.isdisjoint(ws)]
    if not placed and not hits:
        return got
    hit = frozenset(hits)
    share: dict[int, tuple[int, int]] = {}

    def counts(i: int) -> tuple[int, int]:
        """How many words of a line are in exemplars (numbers may be), and how many it has."""
        if i not in share:
            share[i] = sum([w in known or w.isdigit() for w in words[i]]), len(words[i])
        return share[i]

    unit_of: list[tuple[int, int]] = []
    residual: set[int] = set()
    for unit in cut:
        at, n = len(unit_of), len(unit)
        unit_of += [(at, at + n)] * n
        kind = of_places(unit, index) if placed else None
        if not kind and not hit.isdisjoint(range(at, at + n)):
            own = [counts(i) for i in range(at, at + n)]
            passage = " ".join(unit) if n > 1 else unit[0]
            if 2 * sum(k for k, _ in own) >= sum(w for _, w in own) or SPECIAL.search(passage):
                kind = judge(passage, index, inside)
        if kind:
            got[kind] += 1
            residual.update(range(at, at + n))

    def may(i: int) -> bool:
        """Whether a line may be part of a run."""
        return 0 <= i < len(lines) and i not in residual and 0 < counts(i)[1] <= 2 * counts(i)[0]

    done = -1
    for i in hits:
        if i > done and may(i):
            lo = hi = i
            while lo - 1 > done and may(lo - 1):
                lo -= 1
            while may(hi + 1):
                hi += 1
            run = [(j, j == unit_of[j][0], j + 1 == unit_of[j][1]) for j in range(lo, hi + 1)]
            got.update(of_run(run, lines, [(*counts(j), j in hit) for j in range(lo, hi + 1)], index, inside))
            done = hi
    return got


def of_places(unit: list[str], index: Index) -> str | None:
    """The kind of the first window of one term that is an exemplar by itself."""
    for line in unit:
        for _, _, form in places(line):
            if form in index.forms:
                return index.exemplars[index.postings[form][0]][0]
    return None


def of_run(run: list[tuple[int, bool, bool]], lines: list[str], counts: list[tuple[int, int, bool]], index: Index, inside: float) -> Iterator[str]:
    """Kinds of the residue in adjacent lines none of which is in a unit of residue; each line counts once.

    ``run``: a line's place, and whether it is its unit's first and last; ``counts`` go with it. Windows grow line by line to the
    longest exemplar's words and what may be foreign to it; the shortest that is residue is taken.
    """
    if len(run) == 1 and run[0][1] and run[0][2]:
        return
    most = index.longest / inside
    i = 0
    while i < len(run):
        at, first, _ = run[i]
        step, n, hit = 1, 0, False
        if first or apart(lines[at - 1], lines[at]):
            for j in range(i, len(run)):
                end, _, last = run[j]
                n += counts[j][1]
                hit = hit or counts[j][2]
                if n > most and j > i:
                    break
                # a whole unit was judged before
                if hit and (last or apart(lines[end], lines[end + 1])) and not (first and last and not any(run[x][1] for x in range(i + 1, j + 1))):
                    kind = judge(" ".join(lines[at : end + 1]), index, inside)
                    if kind:
                        yield kind
                        step = j - i + 1
                        break
        i += step


def judge(passage: str, index: Index, inside: float = 0.75) -> str | None:
    """The kind of residue a passage is, or None."""
    ts = terms(passage)
    if not ts:
        return None
    get = index.weight.get
    count = Counter(ts)
    total = sum([get(t, index.unknown) * n for t, n in count.items()])
    # no more can be covered than is in exemplars at all
    if sum([get(t, 0.0) * n for t, n in count.items()]) < min(inside, BAG_INSIDE) * total:
        return None
    seen: Counter = Counter()
    for t in count:
        for k in index.postings.get(t, ()):
            seen[k] += index.weight[t] * min(count[t], index.exemplars[k][1][t])
    held = [(k, w) for k, w in seen.items() if w >= index.exemplars[k][3] * index.exemplars[k][2]]
    left, kind, covered = Counter(count), None, 0.0
    for k, w in sorted(held, key=lambda x: (-x[1], x[0])):
        name, words, whole, share = index.exemplars[k]
        # one word of several, or one without its number, is not held
        if sum(t in count for t in words) < min(2, len(words)):
            continue
        while w >= share * whole:  # an exemplar may be there more than once
            took = 0.0
            for t, n in words.items():
                m = min(n, left[t])
                left[t] -= m
                took += m * index.weight[t]
            if not took:
                break
            kind = kind or name
            covered += took
            w = sum(index.weight[t] * min(left[t], n) for t, n in words.items())
    # values are worth nothing once an exemplar is held: any number of them may follow
    if kind and covered >= inside * (total - left[VALUE] * index.weight[VALUE]):
        return kind
    mine = {t: n for t, n in count.items() if t in index.bag}
    if sum(count.values()) >= 3 and sum(n for t, n in mine.items() if t not in index.common) >= 2 and sum(get(t, 0.0) * n for t, n in mine.items()) >= BAG_INSIDE * total and sum(mine.values()) >= BAG_INSIDE * sum(count.values()):
        return "filler"
    return None


def frequencies(documents: DataFrame, text: str = "text") -> DataFrame:
    """``term``, ``documents``, ``beside``, ``anchors``: of every term, in how many documents it occurs, and in how many beside which words of the standard filler.

    ``documents`` of the null term is the number of all.
    """
    out = T.StructType([T.StructField("term", T.StringType()), T.StructField("documents", T.LongType()), T.StructField("beside", T.LongType()), T.StructField("anchors", T.ArrayType(T.StringType()))])
    filler = frozenset(w for w in _words(LOREM) if len(w) > 3) - frozenset(_words(COMMON))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        beside: Counter = Counter()
        anchors: dict[str, set] = {}

        def flush(n: int) -> pa.RecordBatch:
            names = list(seen)
            rows = [pa.array([None, *names], pa.string()), pa.array([n, *seen.values()], pa.int64()), pa.array([0, *(beside[t] for t in names)], pa.int64()), pa.array([[], *(sorted(anchors.get(t, ())) for t in names)], pa.list_(pa.string()))]
            seen.clear()
            beside.clear()
            anchors.clear()
            return pa.RecordBatch.from_arrays(rows, names=out.names)

        n = 0
        for b in batches:
            n += b.num_rows
            for t in b["text"]:
                if not t.is_valid:
                    continue
                cut = list(units(t.as_py()))
                whole = "\n".join(line for unit in cut for line in unit)
                here = set(_words(whole))
                if OPENS.search(whole):
                    here.update(form for _, _, form in places(whole))
                seen.update(here)
                if not filler.isdisjoint(here):
                    with_filler: dict[str, set] = {}
                    for unit in cut:
                        ws = set(_words(" ".join(unit)))
                        found = ws & filler
                        if found:
                            for w in ws:
                                with_filler.setdefault(w, set()).update(found - {w})
                    for w, found in with_filler.items():
                        if found:
                            beside[w] += 1
                            anchors.setdefault(w, set()).update(found)
                if len(seen) >= FLUSH:
                    yield flush(n)
                    n = 0
        yield flush(n)

    counted = documents.select(F.col(text).alias("text")).mapInArrow(count, out)
    return counted.groupBy("term").agg(F.sum("documents").alias("documents"), F.sum("beside").alias("beside"), F.array_distinct(F.flatten(F.collect_list("anchors"))).alias("anchors"))


def index_of(documents: DataFrame, text: str = "text", exemplars: dict[str, Sequence[str]] | None = None) -> Index:
    """The index of the exemplars with frequencies from all ``documents``."""
    named = vocabulary(exemplars)
    joins = (F.size("anchors") >= BESIDE) & (F.col("beside") >= SUPPORT) & (F.col("beside") >= SHARE * F.col("documents"))
    counted = frequencies(documents, text).select("term", "documents", F.coalesce(joins, F.lit(False)).alias("joins"))
    rows = counted.where(F.col("term").isNull() | F.col("joins") | F.col("term").isin(*named)).limit(len(named) + MOST_JOINED + 1).collect()
    if len(rows) > len(named) + MOST_JOINED:
        raise ValueError(f"more than {MOST_JOINED} words join the filler")
    number = {r.term: r.documents for r in rows}
    return Index.build({t: n for t, n in number.items() if t is not None}, number.get(None, 0) or 0, exemplars, [r.term for r in rows if r.joins])


def residue(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", exemplars: dict[str, Sequence[str]] | None = None, inside: float = 0.75) -> DataFrame:
    """``doc_id``, ``kind``, ``passages``: documents with residue in place of dialogue, and how many passages are of which kind.

    ``exemplars`` (kind -> texts) replaces the labelled ones. ``inside`` is the share of a passage's weight
    that exemplars must contain, of which each must be held to its kind's share (``HELD``, else 0.8). Words
    in several languages agree with what recognition errors or a wrong encoding make of them. Null and empty
    texts have no residue; repeated rows with one id add up; other columns are ignored; an empty table gives
    no rows. Sent to the tasks are the exemplars' terms and the words that join the filler, at most
    ``MOST_JOINED``; beyond that the call is refused.
    """
    index = index_of(documents, text, exemplars)
    named = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = T.StructType([named.schema["doc_id"], T.StructField("kind", T.StringType()), T.StructField("n", T.LongType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, kinds, ns = [], [], []
            for i, t in enumerate(b["text"]):
                if not t.is_valid:
                    continue
                for k, n in of_text(t.as_py(), index, inside).items():
                    rows.append(i)
                    kinds.append(k)
                    ns.append(n)
            if rows:
                yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(rows)), pa.array(kinds), pa.array(ns, pa.int64())], names=out.names)

    return named.mapInArrow(find, out).groupBy("doc_id", "kind").agg(F.sum("n").alias("passages"))


def without_residue(documents: DataFrame, *, doc_id: str = "doc_id", **kw) -> DataFrame:
    """``documents`` without those that have residue; rows with a null id stay."""
    bad = residue(documents, doc_id=doc_id, **kw).select(F.col("doc_id").alias(doc_id)).distinct()
    return documents.join(bad, doc_id, "left_anti")
