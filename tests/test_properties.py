"""Properties of the pure functions on generated input."""

from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.dom.render import link_density, normalize, render, truncate_words
from pagewright.dom.tree import body_of, parse, serialize
from pagewright.operators.extract import extract_page

pieces = st.sampled_from(["<p>", "</p>", "<div class='ad-x'>", "</div>", "<a href='u'>", "</a>", "<li>", "<ul>", "</ul>", "<table>", "<tr>", "<td>", "<br>", "<!-- c -->", "<script>x<y</script>", "text ", "a & b ", "&amp;", "<", ">", "\n", "<h3>", "</h3>", "<pre>", "<b>"])
markup = st.lists(pieces, max_size=40).map("".join)


@settings(max_examples=150, deadline=None)
@given(markup)
def test_serialised_trees_are_stable(source):
    once = serialize(body_of(parse(source)))
    assert serialize(body_of(parse(once))) == serialize(body_of(parse(serialize(body_of(parse(once))))))


@settings(max_examples=150, deadline=None)
@given(markup, st.sampled_from(["text", "markdown", "html"]), st.integers(1, 200))
def test_rendering_never_fails(source, output_format, limit):
    content, text = render(source, output_format, limit)
    assert len(text) <= limit and (output_format == "html" or len(content) <= limit)
    assert 0.0 <= link_density(source) <= 1.0
    assert extract_page(source, output_format, limit)[-1] in (None, "READABILITY_EMPTY")


@given(st.text(max_size=80), st.integers(0, 90))
def test_truncation(text, limit):
    cut = truncate_words(text, limit)
    assert len(cut) <= limit and text.startswith(cut)


@given(st.text(max_size=80))
def test_normalisation_is_stable(text):
    once = normalize(text)
    assert normalize(once) == once and "\n\n\n" not in once
