import pytest

from lodegraph.llm.residue import dummy_latin, residue, unfilled_slots, with_residue

SLOTS = ["# {{title}}\n\nWelcome to $!x.author.", "Maintained by [INSERT NAME HERE].", "Overview: <%= page.name %>", "# %%TITLE%%", "This is the home of ${PROJECT_NAME}.", "See __PAGE_AUTHOR__ now", "Limits: <your-project-url>", "# <VERSION GOES HERE>\n\nReal words follow here.", "By XXX_AUTHOR_XXX", "%(name)s is here", "[[page title]]", "Docs for #{lib.name}.", "@@HARBOR@@ rules", "# {% page.title %}",
         "The ${KILN_AUTHOR} of segment is kept in [INSERT VERSION HERE].\n\nMore real text about the matter follows here."]
FILLER = ["Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.", "# Guide\n\nReal words of a real guide.\n\nLorem ipsum dolor amet tempus aliquet nostrum velit magna.", "Your text here. Your text here.", "Coming soon. Coming soon.", "# Usage\n\nSample text. Sample text."]
NOTICES = ["404 Not Found\n\nThe page you asked for is not available.\n\nBack to home", "You need to enable JavaScript to run this app.", "Start > Docs > x\n\nBitte aktivieren Sie JavaScript, um fortzufahren.\n\nImprint | Privacy", '{"message": "Bad credentials", "status": 401}', "Fatal error: uncaught exception in /srv/a.php on line 3\nStack trace:\n#0 /srv/b.php(3): c()\n  thrown", "Access denied. Your address was blocked by a security rule.",
           "This repository has been removed or made private.\nIf you think this is a mistake, write to the owners of x.", "upstream connect error or reset before headers. reset reason: timeout", '<div class="x"><h2>repo</h2><p>The service is down for maintenance. Please check back soon.</p></div>', "<html><head><title>500</title></head><body><h1>500</h1></body></html>", "Página no encontrada. Vuelve al inicio.", "需要启用 JavaScript 才能查看此页面。"]
CONTENT = [
    None, "", "  \n", "ok", "# Title", "vertex\n", "The template engine replaces slots such as `{{ name }}` when the page is built.", "```jinja\n<h1>{{ title }}</h1>\n```\nrenders one heading.", "```sh\nexport A=${A:-/tmp}\n```\n\nSets the folder.", "log(`stale ${pulley} }`);\nreturn x;", "// the phrase may still be open {{\nx = 1;",
    "The handler returns 404 Not Found when the glyph is missing and 503 while the index is rebuilt; clients should retry only the latter.", "We used to fill empty previews with lorem ipsum; since the last release they show the first sentence instead.", 'Fixed: error 500 after a rename. The pass raised "Access denied" because the lease had run out.',
    "Pages wrapped in a `<noscript>` tag are skipped: the crawler has no JavaScript engine, so \"enable JavaScript\" notices would pollute the index.", "Rate limits: after 464 calls per minute the server answers 429 Too Many Requests and names the wait in seconds.", "# Testing\n\nRun the tests.", 'Write "{{ name }}" where the name goes.', "feat(x): load y\n\nIt took 3 ms.", "x" * 300_000,
]


@pytest.mark.parametrize("text", SLOTS)
def test_slots(text):
    assert residue(text) == "slot"


@pytest.mark.parametrize("text", FILLER)
def test_filler(text):
    assert residue(text) == "filler"


@pytest.mark.parametrize("text", NOTICES)
def test_notices(text):
    assert residue(text) == "notice"


@pytest.mark.parametrize("text", CONTENT)
def test_content(text):
    assert residue(text) is None


def test_frame_keeps_rows_and_columns(spark):
    rows = [(1, SLOTS[0], "a"), (1, SLOTS[0], "a"), (2, None, "b"), (None, NOTICES[1], "c")]
    got = with_residue(spark.createDataFrame(rows, "doc_id bigint, text string, residue string")).collect()
    assert sorted((r.doc_id or 0, r.residue) for r in got if r.residue) == [(0, "notice"), (1, "slot"), (1, "slot")] and len(got) == 4
    assert with_residue(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


@pytest.mark.parametrize("text", ["Texte à venir. Texte à venir.", "在此输入内容。", "Describe your project in a few sentences.", "# A\n\nReal words of a guide.\n\n## B\n\nThis section is intentionally left for the author to fill in.", "asdf asdf asdf", "Write something about yourself here."])
def test_requests_to_the_author_are_filler(text):
    assert residue(text) == "filler"


def test_json_error_within_chrome():
    assert residue('Home > Code > x\n\n{"message": "Not Found", "status": 401}\n\nTheme: dark') == "notice"


PAGE = "\n\n404 Not Found\n\nThe page you asked for is not available."
TRACE = "Fatal error: uncaught exception in service" + "".join(f" at org.example.part{i}.Runner.call(Runner.java:{i})" for i in range(40))


@pytest.mark.parametrize("n", [10, 580, 620, 5_000])
def test_notice_after_chrome_of_any_length(n):
    assert residue("Home\n" * n + PAGE) == "notice"
    assert residue("Home\n" * n + PAGE + "\n\nThe index keeps one posting list for every word, sorted by place, and merges them in the background once a minute.") is None


@pytest.mark.parametrize("n", [2, 60, 200, 20_000])
def test_a_sentence_repeated_any_number_of_times(n):
    assert residue("The cat sat here. " * n) == "filler"
    assert residue("猫坐在这。" * n) == "filler"
    assert residue("The cat sat here. " * n + "Then it left for the hills and was not seen again.") is None


def test_long_traces_and_json_errors():
    assert residue(TRACE) == "notice"
    assert residue('{"error": "internal error", "status": 500, "trace": "' + TRACE + '"}') == "notice"
    assert residue('{"title": "Counters", "description": "' + "The counter keeps its value over many restarts of the node. " * 40 + 'A file not found is logged."}') is None


def test_stars_are_code_only_in_comments():
    assert residue("# Notes\n\n* Author: {{author}}\n") == "slot"
    assert residue("**Title:** ${title}\n") == "slot"
    assert residue("/**\n * Author: {{author}}\n */\nint x;\n") is None


@pytest.mark.parametrize("text", ["Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Curabitur vernatus placerat solvim, netus egestas portunum dolor amet.", "Quisque tempus fortarem elit gravatus, mauris lunatis orbitor vestibulum."])
def test_dummy_latin_of_any_make(text):
    assert dummy_latin(text) and residue("# Guide\n\nReal words of a real guide.\n\n" + text) == "filler"


@pytest.mark.parametrize("text", ["The lorem ipsum text of the dolor amet page is gone.", "El texto de la página con lorem ipsum y dolor es para el autor.", "The tempus field holds an integer and the quam field a leo.", "Orbit status forum vertex format deposit data.", "lorem ipsum", "Gallia est omnis divisa in partes tres quarum unam incolunt Belgae."])
def test_no_dummy_latin(text):
    assert not dummy_latin(text)


LESSON = "Templates are filled from the context. Write `{{ name }}` for a name and `{{ date }}` for a date.\n\n```\n{{ title }} by {{ author }}\n```\n\n"


def test_density_tells_a_lesson_from_a_leftover():
    assert residue(LESSON + "Then {{ title }} appears on the page.") is None  # five shown, one open in running prose
    assert residue("Welcome all.\n\nThen {{ title }} appears on the page.") == "slot"
    assert residue(LESSON + "# {{title}}\n\nReal words.") == "slot" and residue(LESSON + "Author: {{author}}") == "slot" and residue(LESSON + "{{body}}") == "slot"
    assert len(unfilled_slots("The {{a}} and the {{b}} of it.\n\nAuthor: ${owner}")) == 3


@pytest.mark.parametrize("n", [10, 390, 410, 5000])
def test_spans_quotes_and_tags_of_any_length(n):
    assert residue("It shows `" + "x" * n + " {{ name }}` as it is, and more follows.") is None
    assert residue('It shows "' + "x" * n + ' {{ name }}" as it is, and more follows.') is None
    assert residue('<div class="' + "x" * n + '">404 Not Found</div>') == "notice"
