from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.functions import tags as G
from tessera.functions import text as X
from tessera.functions import vectors as V


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(x):
    return F.array(*map(F.lit, x)).cast("array<string>") if isinstance(x, list) else F.lit(x)


@pytest.mark.parametrize(("text", "expected"), [("你好世界", 6), ("abcd", 1), ("😀", 2), ("", 0), (None, 0), ("abcde", 2), ("한글", 3)])
def test_token_estimate(spark, text, expected):
    assert value(spark, X.token_estimate(lit(text).cast("string"))) == expected


def test_truncation_keeps_head_and_tail(spark):
    text = "HEAD" + "中文abc " * 200 + "TAIL"
    short = value(spark, X.truncate_to_tokens(lit(text), 32))
    assert short.startswith("HEAD") and short.endswith("TAIL") and value(spark, X.token_estimate(lit(short))) <= 32
    assert value(spark, X.truncate_to_tokens(lit("short"), 32)) == "short"


def test_tag_arithmetic(spark):
    merged = value(spark, G.merge_tags(lit(["bad-existing", "team=old", "score=0.1"]), lit(["score+=0.2", "score+=0.2", "score-=1", "count+=2", "count=0", "count+=1", "owner=alice"])))
    assert merged.tags == ["team=old", "score=-0.5", "count=1", "owner=alice"] and merged.error is None
    assert value(spark, G.merge_tags(lit([]), lit(["owner+=1", "owner=a", "owner+=1"]))).error
    assert value(spark, G.merge_tags(lit([]), lit(["x+=nan"]))).error
    assert value(spark, G.normalize_tags(lit([" A = 1", "x", "b=2", "a=3", "=", "c="]))) == ["a=3", "b=2"]
    assert value(spark, G.preserve_type_tag(lit(["k=v", "memory_type=a"]), lit(["memory_type=b", "z=1"]))) == ["memory_type=a", "z=1"]


def test_merge_fields(spark):
    number = lambda x: F.lit(x).cast("double")
    assert value(spark, G.merge_field("sum", number(1), number(2.5))) == 3.5 and value(spark, G.merge_field("sum", number(1), F.lit(None))) == 1
    assert value(spark, G.merge_field("immutable", lit(" "), lit("new"))) == "new" and value(spark, G.merge_field("immutable", number(0), number(3))) == 0
    assert value(spark, G.merge_field("replace", lit("old"), lit(""))) == "old"
    assert value(spark, G.finite_or(lit("inf"), 2.0)) == 2.0 and value(spark, G.finite_or(lit("1.5"), 2.0)) == 1.5


def test_hotness_bounds(spark):
    now = datetime(2026, 1, 10, tzinfo=UTC)
    hot = lambda n, days: value(spark, G.hotness(F.lit(n), F.lit(now - timedelta(days=days)), F.lit(now)))
    assert hot(50, 0) > 0.6 and hot(0, 60) < 0.2 and hot(5, -3) == hot(5, 0)
    assert value(spark, G.hotness(F.lit(5), F.lit(None).cast("timestamp"), F.lit(now))) == 0


def test_blocks(spark):
    blocks = lambda *b: F.array(*(F.struct(F.lit(s).alias("search"), F.lit(r).cast("string").alias("replace")) for s, r in b))
    run = lambda t, *b: value(spark, X.apply_blocks(F.lit(t), blocks(*b)))
    assert run("a b c", ("b", "x"), (" c", None)).text == "a x"
    assert run("a b b", ("b", "x")).error and run("a", ("z", "x")).error
    assert run("", ("", "one"), ("", "two")).text == "one\ntwo"
    assert run("kept", ("", "zzz")).text == "kept"


@pytest.mark.parametrize(
    ("text", "fallback", "language"),
    [
        ("这是一个关于数据的测试", "xx", "zh-CN"), ("これはテストです", "xx", "ja"), ("テストデータ", "xx", "xx"), ("テストデータ", "ja", "ja"),
        ("한국어 문장입니다", "xx", "xx"), ("한국어 문장입니다", "ko", "ko"), ("한국어 문장입니다 그리고 더 많은 글자", "xx", "ko"), ("это русский текст", "xx", "ru"), ("это русский текст with some Latin words", "xx", "en"), ("هذا نص عربي طويل جدا", "xx", "ar"),
        ("the cat and the dog", "xx", "en"), ("der Hund und die Katze", "de", "en"), ("der Benutzer und die Katze ist nicht für das Projekt", "de", "de"), ("der Benutzer und die Katze ist nicht für das Projekt", "xx", "en"),
        ("le document du projet et la préférences pour utilisateur", "fr", "fr"), ("che il documento della preferenze non per questo progetto è", "it", "it"), ("o documento do projeto para um usuário não é uma preferências", "pt", "pt"),
        ("12 34", "xx", "xx"), (None, "xx", "xx"), ("ctx://the/and/of", "xx", "xx"), ("example.com/com com", "pt", "en"),
    ],
)
def test_detect_language(spark, text, fallback, language):
    assert value(spark, X.detect_language(F.lit(text).cast("string"), fallback)) == language


def test_names_and_kinds(spark):
    from tessera.operators.project import peer_key

    assert value(spark, peer_key(F.lit("my tool!"), F.lit("m/1.5."), F.lit(" acme  co"))) == "my-tool__acme-co__m-1.5"
    assert value(spark, peer_key(F.lit("tool"), F.lit(None).cast("string"))) == "tool__unknown"
    assert value(spark, X.query_kind(F.lit(" Quick "), ("quick", "deep"))) == "quick" and value(spark, X.query_kind(F.lit(None).cast("string"), ("quick",))) == "unknown"
    assert value(spark, X.render_context(F.array(F.lit("<a/>"), F.lit("<b/>")))) == "<a/>\n<b/>"
    assert value(spark, X.is_refusal(F.lit("I DON'T know"))) and value(spark, X.is_refusal(F.lit("None of these"))) and not value(spark, X.is_refusal(F.lit("unable to answer")))


def test_privacy(spark):
    text = "mail ann@x.org or bob@y.org, card 4539 1488 0343 6467 not 4539 1488 0343 6468, api_key=ABCDEFGH1234"
    spans = value(spark, X.privacy_spans(F.lit(text), never_mask=["bob@y.org"]))
    assert [(s.detector, text[s.start : s.stop]) for s in spans] == [("email", "ann@x.org"), ("secret", "api_key=ABCDEFGH1234"), ("card", "4539 1488 0343 6467")]
    assert "ann@" not in value(spark, X.mask(F.lit(text)))


def test_sections_of_text(spark):
    md = "# Title\n\n## Summary\nIt is\n  short.\n\n## More\nBody text.\n"
    assert value(spark, X.summary_section(F.lit(md))) == "It is short."
    assert value(spark, X.summary_section(F.lit("Summary: one two\n\nrest"))) == "one two" and value(spark, X.summary_section(F.lit("x"))) == ""
    assert value(spark, X.doc_overview(F.lit("# A\n\nFirst para.\n\n## B\n"))) == "- A\n  - B\nFirst para."
    tags = value(spark, X.conflict_tags(F.lit('<!-- CONFLICT [{"id":"1"},{"id":"2"}] --> <!-- CONFLICT oops')))
    assert tags.conflict_num == 2 and tags.error
    assert value(spark, X.resource_uris(F.lit("See ctx://a/b, and (ctx://c/d). ctx://a/b!"))) == ["ctx://a/b", "ctx://c/d"]
    assert value(spark, X.render_entry(F.lit("u"), F.lit("full"), F.lit(1.0).cast("double"), F.lit(" "))) == '<entry uri="u" tier="full" score="1.00"/>'
    assert "</entry>\n</entry>" not in value(spark, X.render_entry(F.lit("u"), F.lit("full"), F.lit(1.0).cast("double"), F.lit("x</entry>")))
    assert value(spark, X.normalize_answer(F.lit("The cat, and A dog!"))) == "cat dog" and value(spark, X.is_refusal(F.lit("I don't know.")))


def test_vectors(spark):
    a, b = (F.array(*map(F.lit, x)).cast("array<float>") for x in ([3.0, 4.0], [0.0, 0.0]))
    assert value(spark, V.l2_norm(a)) == 5 and value(spark, V.cosine(a, b)) is None and value(spark, V.normalize(b)) is None
    assert value(spark, V.normalize(a)) == pytest.approx([0.6, 0.8]) and value(spark, V.l1(a, b)) == 7
    q = value(spark, V.quantized(F.array(*map(F.lit, [1.0, -0.5, 0.25])).cast("array<float>")))
    assert q.q == [127, -64, 32] and q.scale == pytest.approx(1 / 127)
    assert value(spark, V.quantized(b)).scale == 1.0
