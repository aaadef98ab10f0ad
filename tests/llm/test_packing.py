def test_workers_forget_pieces_and_pack_a_group_each(monkeypatch):
    """Tasks that pack hold no memo of encoded pieces, and about a group each."""
    from corpuscle.llm import packing, tokens

    model = tokens.WordEncoder(tokens.default_path())
    monkeypatch.setattr(tokens, "_ENCODERS", {"x": model})
    before = model.encode("Some words, and some more!")
    packing.forget()
    assert not model.pieces and not model.words and packing.TASK_GROUPS == 1
    assert model.encode("Some words, and some more!") == before
