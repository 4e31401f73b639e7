"""Notices that stand close together: each is reported, whichever of them is the more exact."""

import random

from reweave.llm import license_scan


def test_a_less_exact_notice_before_an_exact_one_is_found():
    notice = "all rights reserved"
    fuzzy = license_scan.Fuzzy(notice, "x", len(notice) // 9)
    rng = random.Random(5)
    assert [text[a:b] for text in [b"x all rights reservd all rights reserved y"] for a, b, _ in fuzzy.search(text)] == [b"all rights reservd", b"all rights reserved"]
    for _ in range(300):
        forms = [rng.choice(["all rights reserved", "all rights reservd", "all rghts reservd", "all rigths reserved"]) for _ in range(rng.randint(1, 5))]
        text = " ".join(["x", *forms, "y"]).encode()
        found = fuzzy.search(text)
        assert [text[a:b].decode() for a, b, _ in found] == forms, text


def test_windows_passed_over_hold_no_notice(monkeypatch):
    rng = random.Random(8)
    words = "neither the name of the copyright holder nor names its contributors free and domain all rights".split()
    for notice in license_scan.NOTICES:
        edits = len(notice) // 9
        fuzzy = license_scan.Fuzzy(notice, "x", edits)
        texts = []
        for _ in range(12):
            own = list(notice)
            for _ in range(rng.randint(0, edits + 1)):
                own[rng.randrange(len(own))] = rng.choice(["", "x", "ab", " "])
            noise = [" ".join(rng.choices(words, k=30)) for _ in range(2)]
            texts.append(" ".join(f"{noise[0]} {''.join(own)} {noise[1]}".split()).encode())
        found = [fuzzy.search(t) for t in texts]
        with monkeypatch.context() as m:
            m.setattr(license_scan.Fuzzy, "likely", lambda self, window: True)
            assert [fuzzy.search(t) for t in texts] == found
        assert any(found)


def test_one_window_of_a_whole_text_is_read_in_pieces():
    notice = "all rights reserved"
    fuzzy = license_scan.Fuzzy(notice, "x", len(notice) // 9)
    text = b" ".join([notice.encode()] * 2000)
    assert [(a, b, e) for a, b, e in fuzzy.search(text)] == [(20 * k, 20 * k + 19, 0) for k in range(2000)]
