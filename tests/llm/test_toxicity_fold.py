from terracell.llm import toxicity


def wide(word):
    return "".join(chr(ord(c) + 0xFEE0) for c in word)


def bold(word):
    return "".join(chr(0x1D41A + ord(c) - ord("a")) for c in word)


def test_every_form_of_l_folds_as_ascii_does():
    for c in "ｌＬĺļľĹĻĽℓ":
        assert toxicity.fold(f"{c}oser") == toxicity.fold("loser"), c
    for word in ("loser", "clown", "worthless"):
        assert toxicity.fold(wide(word)) == toxicity.fold(word)


def test_letters_above_the_first_plane_fold():
    for word in ("loser", "idiot", "trash"):
        assert toxicity.fold(bold(word)) == toxicity.fold(word)
    assert toxicity.fold("\U0001d4f5oser a\U0001f642b") == toxicity.fold("loser") + " a b"
    assert toxicity.fold("a\U00020000") == "a\U00020000"  # a letter without a plain form stays


def test_disguised_words_score():
    lex = toxicity.Lexicon({toxicity.fold("loser"): 5.0}, (), 0.5, 20.0, -2.0)
    for t in ("you loser", f"you {wide('loser')}", f"you {bold('loser')}"):
        assert float(lex.score(*zip(lex.raw(t)))[0]) > 0.5, t
