"""Values after "is" are scored as any others."""

from dialoom.llm import secrets


def test_letters_only_after_is():
    text = "Hello. The password is kqzvwxjtrbnmplh, and the token is required here."
    assert secrets.scan(text) == [("guess", 23, 38)]
    assert secrets.masked(text, secrets.scan(text)) == "Hello. The password is [SECRET], and the token is required here."
