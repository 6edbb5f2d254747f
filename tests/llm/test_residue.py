import pytest

from shapelake.llm import residue

FOUND = [
    "Review of {{case}} on 2025-01-01",
    "Reviewer: ${REVIEWER}\nEngine: sa1",
    "The %s of %s is kept.",
    "Source digest: <insert sha256>",
    "phase <%= phase_no %>: PASS",
    "The mask of @@PART@@ is small.",
    "Engine: #{version}",
    "Reviewer: __REVIEWER_NAME__",
    "Fixing ______ alone would do.",
    "The mask of the XXX covers XXX percent",
    "Verdict: undefined",
    "keeps [object Object] regions",
    "Date: TBD-DATE",
    "A level of {n} keeps about {total} shapes.",
    "saw that «effect» and asked",
    "needs $amount$ MiB",
    "%DATE%T%CLOCK%Z INFO",
    "Verdict: [[result]]",
    "Stage: [stage_name here]",
    "Run on: (runner to be filled in)",
    "found :part_name: dark",
    "First bad phase: {0}",
    "REVIEW OF {{CASE}} ON MONDAY",
    "図形の総数はXXX個である。",
    "All is well. The rest is real.\n\nLorem ipsum dolor sit amet consectetur.",
    "Anim laborum pariatur aliqua eiusmod veniam sunt.",
    "Real text.\n\nblah blah blah blah",
    "text text text text text text",
    "Summary\nAdd a short summary",
    "Risk\n[write here]",
    "Dies ist ein Platzhalter. Hier steht später der Text.",
    "この文章はダミーです。",
    '{"note": "The old {metric} was computed"}',
    "404 Not Found",
    "Error 404\n\nWe can't find that case.\n\nTrace: 650a7e2895",
    '{"error":{"code":404,"message":"token expired"}}',
    "<html><head><title>403</title></head><body><h1>Forbidden</h1><hr>babb32100a</body></html>",
    "Menu  Reports  Downloads  Help\n\nPlease enable Javascript to view the gate overview.",
    "Checking your browser before opening the workspace…",
    "Fehler 404 – Seite nicht gefunden\nDie angeforderte Seite existiert nicht mehr.",
    "Acceso denegado. Inicie sesión de nuevo.",
    "ブラウザを確認しています。しばらくお待ちください…",
    "OOPS!\n\nTHE GATEWAY GOT NO VALID ANSWER FROM THE WORKER.",
]
NOT_FOUND = [
    None,
    "",
    " \n\t ",
    "PASS",
    "OK 12ab34cd",
    "The template test renders {{case_id}} with an empty record and expects an exception.",
    "The report writer looks for `${STAGE}` in the layout file.",
    "Die Vorlage ersetzt `${CASE}` durch den Namen des Falls.",
    "報告書の雛形では `{{ case_id }}` が案件名に置き換えられる。",
    '```\nexport OUT=work/1\npython run.py --in ${OUT}/in.png\n```',
    "export OUT=work/1\npython run.py --in ${OUT}/in.png",
    'Call `f"{case}: {score:.3f}"` prints the score and `%s` is not used.',
    "TODO: rerun the stage with the frozen mask.",
    "Open points [4] and [11] are TBD with Ann; the rest is closed.",
    'Imbro reported that the card still showed "Lorem ipsum dolor anim labore amet." on the nightly run.',
    "Der Blindtext im Entwurf wurde am Dienstag durch den Bericht ersetzt.",
    "En X la pieza «manga izquierda» se fundió con el fondo.",
    "It covers 50% of A and 20% of B.",
    "at 10:20:30 and 11:30:40",
    "- [x] ask for a second review",
    "| status | body | meaning |\n| 404 | Not Found | the case id is unknown |\n| 503 | Service temporarily unavailable | the worker restarts |",
    'With scripts switched off the workspace shows "Please enable JavaScript to view the workspace" and offers the plain form.',
    "スクリプトが無効な場合は「JavaScriptを有効にしてください」と表示される仕様であることを確認した。",
    "2026-01-17T17:40:33Z ERROR fetch of mask failed: HTTP 404, retry 1",
    "This site works best with JavaScript enabled.\n\nThe mask of the cape covers 3 percent of the canvas, which explains the score.",
    "<|endoftext|> </s> <unk>",
]


@pytest.fixture(scope="module")
def detector():
    return residue.Detector()


@pytest.mark.parametrize("text", FOUND)
def test_found(detector, text):
    assert detector.kind(text)


@pytest.mark.parametrize("text", NOT_FOUND)
def test_not_found(detector, text):
    assert detector.kind(text) is None


def test_whole_long_texts_are_read(detector):
    real = "The mask of the cape covers 3 percent of the canvas. " * 20_000
    assert detector.kind(real) is None
    assert detector.kind(real + "Reviewer: ${REVIEWER}") == "residue"


def test_table_with_clashes_repeats_and_nulls(spark):
    rows = [(i, t, "x") for i, t in enumerate(FOUND + NOT_FOUND)] + [(0, FOUND[0], "x"), (None, FOUND[0], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    got = [r.doc_id for r in residue.flag_residue(df).collect()]
    assert sorted(g for g in got if g is not None) == sorted([*range(len(FOUND)), 0]) and got.count(None) == 1
    assert residue.flag_residue(df.filter("false")).count() == 0


OPEN_EXPRESSIONS = ["Hello {{ user.name }},", "Title: {{ name | upper }}", "Case {{case-id}} is kept", "Kunde: {{größe}}", "担当: ${担当者}", "{{ नाम }} ok", "Stage: <%= run.stage %>", "Sum #{a.b}", "See [[case-name]]", "Total {{ items[0].price | default: '0' | round(2) }}", "{% if user.name == 'x' %}yes", "Rows: {%- for x in rows -%}"]
NO_EXPRESSIONS = ["Matrix [[0.5 0.2]] and [[1.5, 2]]", "The template test renders {{ user.name }} with an empty record.", "Run `{% if x %}` first.", "set OUT=a\nuse ${OUT-b} here", "A gain of {5% to 6%} was seen."]


@pytest.mark.parametrize("text", OPEN_EXPRESSIONS)
def test_open_expressions_are_found(text):
    assert residue.Detector().kind(text) == "residue"


@pytest.mark.parametrize("text", NO_EXPRESSIONS)
def test_no_expressions(text):
    assert residue.Detector().kind(text) is None
