"""Residue: labelled positives and hard negatives, damage, degenerate texts."""

import pytest

from tidewatch.llm import residue

TALK = "The captain carried the letter home before the rain came."
YES = [
    "{{name}}", "He lifted the {{ place }} gate.", "${cue_text}", "#{hero} ran.", "<%= cue.text %>", "[[SPEAKER]]: [[LINE]]", "%DIALOGUE_12%", "$LINE$", "__TEXT_9__", "@@LINE@@", "{0}: {1}", "{subtitle_4}", "<<line 3>>", "<CHARACTER NAME> ran.", "&lt;cue text&gt;", "undefined", "[untranslated]", "[insert dialogue here]",
    "(your text here)", "TODO: translate this line", "xxxx xxx xxxxx", "bla bla bla bla", "Sample subtitle text", "Dummy line 44", "Test cue, please ignore", "Quisque omnut ardus caret lorem velor.", "404 Not Found", "Access Denied", "Error 503\nService temporarily unavailable\nRequest ID: 99ab12cd",
    "Please enable JavaScript and cookies to continue", "Veuillez activer JavaScript pour afficher cette page.", "Página no encontrada", "Seite nicht gefunden", "P�gina no encontrada", "Access Deriied", "<html><head><title>Access Denied</title></head>\n<body>\n<p>Access Denied</p></body></html>",
]
NO = [
    TALK, "[sign: INSERT COIN]", "{\\an8}Not now.", "{y:i}Undefined borders, Ann wrote.", "<i>Thank you.</i>", '<font color="#ffff00">Stay here.</font>', "Sign here, Ann: ________", "It costs $20, or 100% of what you own.", "Turn on JavaScript, said Ann, and the whole shop window woke up.", "Undefined, Ann? My feelings for you are anything but undefined.",
    "Blah, blah, blah, that's all I ever hear from Ann.", "My teacher could recite lorem ipsum backwards, Ann told us.", "Access denied! You always wanted to shout that, Ann.", "Too many requests, Ann. The waiter has only two hands.", "Just write your text here, on the back of the ticket.", "Downloaded from www.example.com", "[door creaks]", "♪ slow music ♪", "Not now.", "404 coins for the bridge.", "",
]


def cue(text):
    return f"1\n00:00:01,000 --> 00:00:02,000\n{TALK}\n\n2\n00:00:03,000 --> 00:00:04,000\n{text}\n\n3\n00:00:05,000 --> 00:00:06,000\nAre you coming?\n"


@pytest.fixture(scope="module")
def found(spark):
    # filler of a generator, whose words aren't in the standard one: they join its bag
    rest = [cue(f"{a} omnut ardus {b} caret velor.") for a, b in [("Lorem", "ipsum"), ("Ipsum", "quisque"), ("Quisque", "lorem"), ("Sit amet", "omnut")]]
    texts = [*[cue(t) for t in YES], *YES, *[cue(t) for t in NO], *NO, None, "", "\n\n", "1\n2\n", TALK * 5000, *rest]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, kind string, passages int")
    return {r.doc_id for r in residue.residue(df.repartition(3)).collect() if r.doc_id < len(texts) - len(rest)}, len(texts) - len(rest)


def test_positives(found):
    got, _ = found
    assert [t for i, t in enumerate(YES) if i not in got] == []
    assert [t for i, t in enumerate(YES) if i + len(YES) not in got] == []


def test_negatives_and_degenerate_texts(found):
    got, n = found
    assert [i for i in sorted(got) if i >= 2 * len(YES)] == []


def test_exclusion_and_empty(spark):
    df = spark.createDataFrame([(1, cue("undefined"), "a"), (2, cue(TALK), "b"), (None, "undefined", "c")], "doc_id long, text string, source string")
    assert sorted(r.source for r in residue.without_residue(df).collect()) == ["b", "c"]
    assert residue.residue(df.where("false")).count() == 0


def test_quick_sorting_out_loses_nothing():
    index = residue.Index.build({}, 100)
    for t in [*YES, *NO]:
        text = cue(t)
        slow = sum((residue.of_places([p], index) or residue.judge(p, index)) is not None for p in residue.passages(text))
        assert sum(residue.of_text(text, index).values()) == slow


NOTICE = ("You need to have scripts turned on in your", "browser to view this page.")


SPLIT = "You need to have scripts turned on in your\n\n3\n00:00:05,000 --> 00:00:06,000\nbrowser to view this page."


@pytest.mark.parametrize("text", ["\n".join(NOTICE), "\n".join([TALK, *NOTICE, TALK]), cue(SPLIT), cue("404 Not Found\n" + TALK), cue(TALK + "\n[untranslated]"), cue("\n".join([TALK, *NOTICE]))])
def test_residue_over_lines_and_cues(text):
    index = residue.Index.build({}, 100, {"notice": ["You need to have scripts turned on in your browser to view this page.", "untranslated", "404 Not Found"]})
    assert sum(residue.of_text(text, index).values()) == 1
    assert residue.of_text(text, residue.Index.build({}, 100))


def test_sentences_over_lines_are_dialogue():
    index = residue.Index.build({}, 100)
    for text in (cue("My feelings for you are anything but\nundefined."), cue("Just write your text here,\non the back of the ticket."), "Just write your\ntext here, on the back of the ticket, she told us and went"):
        assert not residue.of_text(text, index)


LOREM = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum."


def test_standard_filler():
    index = residue.Index.build({}, 100)
    for text in (LOREM, *LOREM.split(". "), "Lorem ipsum", "sed do eiusmod tempor incididunt", "Sed ut perspiciatis unde omnis iste natus error sit voluptatem", "Vestibulum ante ipsum primis in faucibus"):
        assert residue.of_text(text, index)["filler"] and residue.of_text(cue(text), index)["filler"], text
    for text in ("Do it in a minute.", "In class, in a minute?", "Et in Arcadia ego.", "Est-ce que tu es là?", "Non, per nulla.", "Do sit in.", "Error in class A."):
        assert not residue.of_text(cue(text), index), text


NAMED = ["[INSERT NAME]", "{name}", "Dear {name}, come in.", "<PLACEHOLDER>", "TBD", "Enable scripts to continue", "Error 500 12 13", "{{" + "x" * 70 + "}}", "%(count)d birds", "{% block body %}", "We're sorry but this shop doesn't work properly without JavaScript enabled.", "HTTP error 503", "Pagina niet gevonden", "Errore interno del server. Riprova più tardi.", "Vous avez dépassé la limite de téléchargements."]


def test_forms_and_phrases_of_any_length():
    index = residue.Index.build({}, 100)
    assert [t for t in NAMED if not residue.of_text(cue(t), index)] == []
    assert [t for t in ("Gone.", "Locked!", "Conflict?", "¿Todo?", "Null.", "Forbidden.", "I want you to go back later.", "{1}{72}Not now.", "{b}Not now{/b}", "<v Ann Lee>Not now.", "<I>Not now.</I>", "<font size=3>Not now.</font>") if residue.of_text(cue(t), index)] == []


def test_exemplars_of_ones_own(spark):
    """Phrases that no table has, held in part, damaged, and over lines."""
    own = {"stamp": ["This parchment was left blank by the scriptorium", "{{name}}"]}
    rows = [(1, cue("This parchment was left blank by the scriptorium")), (2, cue("This parchrnent was left b1ank\nby the scriptorium.")), (3, cue("The scriptorium left at dawn.")), (4, cue("Hello {{ name }}!")), (5, cue("Hello ${name}!")), (6, "This parchment was left blank\nby the scriptorium")]
    got = {r.doc_id: r.kind for r in residue.residue(spark.createDataFrame(rows, "doc_id long, text string"), exemplars=own).collect()}
    assert got == {1: "stamp", 2: "stamp", 4: "stamp", 6: "stamp"}


def test_value_term_has_a_frequency(spark):
    df = spark.createDataFrame([(cue("room 12 and 13"),), (cue("no number"),)], "text string")
    got = {r.term: r.documents for r in residue.frequencies(df).collect()}
    assert got[None] == 2 and residue.VALUE in residue.terms("Error 500 12") and residue.Index.build(got | {}, 2).weight[residue.VALUE] == 0.5
