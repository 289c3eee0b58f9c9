from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tickloom.llm import tokens

PATH = tokens.tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)


def plain(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_counts_match_library(odd_docs, no_docs):
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.token_digest(odd_docs, PATH).collect())
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), plain(r["text"]), plain(r["text"]) > 512) for r in odd_docs.collect())
    assert got == want
    assert tokens.token_digest(no_docs, PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "the", " the", "'s", "12", "!", "é", "日本", "\x1c", "\x85", " ", "<|endoftext|>", "\r\n"]), max_size=12))
def test_pieces_add_up(parts):
    text = "".join(parts)
    assert "".join(tokens.pieces(text)) == text
    assert ENCODER.count(text, {}) == plain(text)


ENCODER = tokens.Encoder(PATH)


def test_long_text_is_cut_safely(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_CHARS", 50)
    text = "some words, and  more\n words 12 " * 40
    assert "".join(tokens.slices(text)) == text
    assert ENCODER.count(text, {}) == plain(text)
