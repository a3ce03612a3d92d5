import hashlib

import pytest
from compare import differences, duck
from hypothesis import given, settings
from hypothesis import strategies as st
from tables import SF, frame

from stratocast.llm import chat
from stratocast.llm import templates as t

PIECES = st.lists(st.sampled_from(["<", "|", "\\", "<|", "|>", "<|im_end|>", "<|im_start|>", "\n", "n", "x", "é😀", "<\\|"]), max_size=10).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), PIECES), PIECES), max_size=5))
def test_any_texts_come_back(turns):
    text, spans = t.compile_template(chat.CHATML, chat.CHAT_FILTERS)({"messages": [{"role": r, "text": x} for r, x in turns]})
    assert chat.parse_chatml(text) == turns
    assert [chat.unguard(text[a:b]) for a, b in spans] == [x for r, x in turns if r == "assistant"]


@pytest.mark.parametrize(
    "source, variables, want",
    [
        ("a{{ x }}b", {"x": 3}, "a3b"),
        ("{{ none }}{{ true }}{{ y }}", {}, "true"),
        ("{% for x in xs %}{{ loop.index }}{{ x.k }}{% if not loop.last %}, {% endif %}{% endfor %}", {"xs": [{"k": "a"}, {"k": "b"}]}, "1a, 2b"),
        ("{% if a == 1 %}one{% elif a > 1 and a < 4 %}few{% else %}more{% endif %}", {"a": 3}, "few"),
        ("{% set z = 'q' ~ 1 + 2 %}{{ z | upper }}", {}, "Q12"),
        ("x {%- if true -%}  y {%- endif %} z", {}, "xy z"),
        ("a {#- no -#} b", {}, "ab"),
        ("{{ 'in' if 'a' in xs else 'out' }}{{ xs[0] }}{{ xs[9] }}{{ xs.k }}", {"xs": ["a"]}, "ina"),
        ("{{ x is none }}{{ x is not none }}{{ -2 * 3 }}", {}, "truefalse-6"),
        ("{{ xs | join('-') }}{{ xs | length }}{{ y | default('d') }}", {"xs": [1, 2]}, "1-22d"),
        ("{{ s.upper }}{{ s.__class__ }}{{ 'a\\'b' }}", {"s": "text"}, "a'b"),
    ],
)
def test_language(source, variables, want):
    assert t.compile_template(source)(variables)[0] == want


@pytest.mark.parametrize("source", ["{% for %}", "{{ f(x) }}", "{% if x %}", "{% endif %}", "{% what %}", "{{ x | eval }}", "{{ 1 + }}", "{{ ` }}", "{% if x %}{% endfor %}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{% for a b %}{% endfor %}"])
def test_faulty_templates(source):
    with pytest.raises(t.TemplateError):
        t.compile_template(source)


def test_constants_are_folded():
    tree = t.fold(t.parse("a{{ 'b' ~ 1 + 2 }}{% if 1 == 1 and true %}c{% else %}{{ x }}{% endif %}{{ 'd' | upper }}{{ x }}"), t.FILTERS)
    assert tree == t.Block((t.Write(t.Const("ab12cD")), t.Write(t.Name("x"))))


def test_generation_spans():
    text, spans = t.compile_template("é{% generation %}{% for x in xs %}{{ x }}{% endfor %}{% endgeneration %}!{% generation %}{% endgeneration %}")({"xs": ["ab", "c"]})
    assert text == "éabc!" and spans == [(1, 4), (5, 5)]


def test_as_sql(spark):
    assert differences(spark, duck(SF), chat.op1_chat, chat.OP1_SQL, SF) is None


def plain(rows):
    by = {}
    for c, k, r, x in rows:
        by.setdefault(c, []).append(((k is not None, k or 0), r or "", x or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        learned = "".join(x for _, r, x in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), learned))
    return sorted(out, key=str)


def test_awkward_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x" * 200_000), (1, 1, "assistant", "tie"), (2, 0, None, ""), (2, 0, None, ""), (None, None, "assistant", "<|im_end|>"), (None, 3, "a\nb", "\\n"), (3, 5, "assistant", None), (4, -1, "assistant", chat.TRICKY)]
    out = chat.read_chats(chat.format_chats(frame(spark, rows, columns="conv_id long, turn long, role string, text string"))).collect()
    got = [(r.conv_id, len(r.turns), hashlib.sha256("".join(f"{x.role}\n{x.text}\n" for x in r.turns).encode()).hexdigest(), r.learned) for r in out]
    assert sorted(got, key=str) == plain(rows)


def test_empty_table(spark):
    df = frame(spark, [], columns="conv_id long, turn long, role string, text string")
    assert chat.read_chats(chat.format_chats(df)).count() == 0


def test_faulty_template_fails_at_once(spark):
    with pytest.raises(t.TemplateError):
        chat.format_chats(frame(spark, [], columns="conv_id long, turn long, role string, text string"), "{% if %}")
