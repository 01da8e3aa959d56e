"""Policies that a text names: plain words are looked for before a pattern is, with the same result."""

import re

import pytest

from sitelens.functions import dom
from sitelens.functions import values as V

#: The patterns' own alternatives as texts, with and without what is optional in them.
PHRASES = [re.sub(r"\\s\*", space, re.sub(r"\([^()]*\)\??|\(|\)", group, p)).replace("?", "") for _, ps in V.POLICY_ANCHORS for p in ps.split("|") for space in ("", " ", "\n ") for group in ("", " policy")]
TEXTS = [*PHRASES, *map(str.upper, PHRASES), "T & C", "t&c", "Data  Protection", "money\nback", "Return & Exchange", "conditions d'utilisation", "ter\u017f", "co\u212aie policy", "Nothing here", "", "  reso ", "Politique de retour"]


@pytest.mark.parametrize("text", TEXTS)
def test_guards_lose_no_match(text):
    assert dom.named_policies(text) == [k for k, p in V.POLICY_ANCHORS if re.search(p, text.strip(), re.I)]


def test_plain_texts_take_no_pattern(monkeypatch):
    tried = []

    class Spy:
        def search(self, text):
            tried.append(text)

    monkeypatch.setattr(dom, "_ANCHOR_WORDS", [(k, Spy()) for k, _ in V.POLICY_ANCHORS])
    list(dom.links("<body><p>Nothing here</p><li><a href='/a'>One</a></li>", "https://a.example/"))
    assert not tried
