import random

import pytest

from calibra.llm import decontaminate as dec


def corpus(seed=4):
    rng = random.Random(seed)
    word = lambda: rng.choice("th er on an in re ha ou".split()) + rng.choice("tion ble ing ed ly nt".split()) + rng.choice(["", "s", "er"])
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(rng.randint(9, 40)) for _ in range(25)] + [None, "", "too short", text(6)]
    docs, want = [None, "", "!!! ..."], set()
    for i in range(120):
        body = text(rng.randint(0, 120))
        if i % 3 == 0:
            k = rng.randrange(25)
            body = body + " " + items[k] + ". " + text(rng.randint(0, 60))
            want.add((len(docs), k))
        docs.append(body)
    docs.append(items[28] + " " + text(10))
    want.add((len(docs) - 1, 28))
    return items, docs, want


def tables(spark, items, texts):
    b = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    return d, b


@pytest.mark.parametrize("tokens", [dec.BLOCK_TOKENS, 100])
def test_planted_items_are_found_and_clean_documents_left(spark, tokens):
    items, texts, want = corpus()
    d, b = tables(spark, items, texts)
    got = {(r.doc_id, r.item_id) for r in dec.find_leaks(d, b, tokens=tokens).collect()}
    assert got == want
    left = dec.drop_contaminated(d, b, tokens=tokens)
    assert left.columns == d.columns
    assert {r.doc_id for r in left.collect()} == set(range(len(texts))) - {i for i, _ in want}


def brute(items, texts):
    """All windows of all items against all windows of all documents, token by token."""
    ix = dec.Index(items)
    out = set()
    for d, t in texts:
        chunks = (t or "").split()
        ids = dec.template(ix.codes(chunks)).tolist() if chunks else []
        for k, (item, own, _) in enumerate(ix.items):
            own = own.tolist()
            w = min(dec.WINDOW, len(own))
            runs = {}
            for q in range(len(own) - w + 1) if w >= dec.LITERALS else ():
                if sum(x > dec.NAME for x in own[q:q + w]) >= dec.LITERALS:
                    for p in range(len(ids) - w + 1):
                        if ids[p:p + w] == own[q:q + w]:
                            runs.setdefault(p - q, []).append((q, q + w))
            cover, longest = set(), 0
            for shift, parts in runs.items():
                for a, b in dec.joined(parts):
                    if dec.consistent(ix.items[k], chunks, a, b, shift) is not None:
                        cover |= set(range(a, b))
                        longest = max(longest, b - a)
            if cover and (len(cover) >= dec.COVER * len(own) or longest >= dec.RUN):
                out.add((d, item))
    return out


def test_index_matches_brute_force():
    items, texts, _ = corpus(9)
    rng = random.Random(2)
    for _ in range(60):  # cut and spliced passages, figures and names
        a, b = rng.choice(items[:25]).split(), rng.choice(items[:25]).split()
        i, j = rng.randrange(len(a)), rng.randrange(len(b))
        texts.append(" ".join(a[i:i + rng.randint(3, 20)] + rng.choice([[], ["12"], ["Anna"]]) + b[j:j + rng.randint(3, 20)]))
    ix = dec.Index(list(enumerate(items)))
    got = {(d, leak[0]) for d, t in enumerate(texts) for leak in ix.leaks(t)}
    assert got == brute(list(enumerate(items)), list(enumerate(texts)))


@pytest.mark.parametrize("item,text,found", [
    ("Yes", "he said yes today", False), ("Yes", "He said:\n  yes \nand left", True), ("Yes", "Yes", True), ("Yes", "yes and no", False),
    ("Yes", "Will it? Yes. It will.", True), ("The end", "so the end came", False), ("The end", "a\r\nthe end\r\nb", True),
    ("In the end", "so in the end it was", True)])
def test_short_items_must_be_whole_lines_or_sentences(item, text, found):
    assert bool(dec.Index([(1, item)]).leaks(text)) == found


QUESTION = "Anna has 12 apples and gives 5 apples to Bob, who then has 9 kg of fruit in his big basket today."


@pytest.mark.parametrize("text,found", [
    (QUESTION, True), ("Well. " + QUESTION.upper(), True),
    ("Maria has 30 apples and gives 7 apples to Peter, who then has 4 lb of fruit in his big basket today.", True),
    ("Maria has 30 apples and gives 7 apples to Maria, who then has 4 lb of fruit in his big basket today.", False),
    ("Anna buys 12 pears and gives them all away.", False)])
def test_slots(text, found):
    leaks = dec.Index([(7, QUESTION)]).leaks(text)
    assert bool(leaks) == found
    if found:
        assert leaks[0][0] == 7 and leaks[0][3] == (QUESTION.lower() in text.lower())


def test_empty_tables(spark):
    d, b = tables(spark, [], ["x"])
    assert dec.find_leaks(d, b).collect() == [] and dec.drop_contaminated(d, b).count() == 1
    d, b = tables(spark, ["a b c d e f g h i"], [])
    assert dec.find_leaks(d, b).collect() == []


LONG = ("The farmer keeps 3 apples in a large wooden box near the old barn where the hungry horses sleep all night long "
        "and every morning before breakfast the youngest child counts again what is left inside and writes 3 pears down.")


@pytest.mark.parametrize("item,text,verbatim", [
    (LONG, LONG.replace("3 pears", "8 pears"), False),  # verbatim but for one place of a value that occurs twice
    (LONG, LONG.replace("3 apples", "41 apples").replace("3 pears", "8 pears"), False),  # other figures, one slip
    (LONG.replace("horses", "Bob").replace("child", "Anna"), LONG.replace("horses", "Bob").replace("child", "Bob"), False),
    ("We pick 3 apples and sell all of them for 3 euros now", "We pick 3 apples and sell all of them for 8 euros now", False)])
def test_contradicting_slot_splits_the_run(item, text, verbatim):
    leaks = dec.Index([(7, item)]).leaks("Well said. " + text)
    assert [leak[0] for leak in leaks] == [7] and leaks[0][3] == verbatim


def test_contradictions_match_every_pair_of_slots():
    """Numbers only: a document holds the item if some stretch of it, half of it or RUN tokens, has no two places where
    one number of the item stands for two of the document."""
    rng = random.Random(11)
    seen = set()
    for _ in range(400):
        n = rng.randint(12, 45)
        item = [rng.choice("345") if i % rng.randint(2, 9) == 1 and i % 2 else f"w{rng.choice('abcdefgh')}o{i}" for i in range(n)]
        text = [rng.choice("3456") if t.isdigit() and rng.random() < 0.3 else t for t in item]
        if any(sum(not t.isdigit() for t in item[i:i + 8]) < dec.LITERALS for i in range(n - 7)):
            continue
        want = False
        for a in range(n):
            for b in range(a + 1, n + 1):
                pairs = {(x, y) for x, y in zip(item[a:b], text[a:b]) if x.isdigit()}
                one = len(pairs) == len({x for x, _ in pairs}) and sum(not t.isdigit() for t in item[a:b]) >= dec.LITERALS
                want |= one and (b - a >= dec.RUN or b - a >= dec.COVER * n)
        got = bool(dec.Index([(1, " ".join(item))]).leaks(" ".join(text)))
        assert got == want, (item, text)
        seen.add(got)
    assert seen >= {True}


@pytest.mark.parametrize("item,text", [
    ("Anna has 12 kg, Bob has 9 kg, Carol has 7 kg, Peter has 3 kg", "Anna has 12 kg, Bob has 9 kg, Carol has 7 kg, Peter has 3 kg"),
    ("1 1 2 3 5 8 13 21 34 55 89 144", "1 1 2 3 5 8 13 21 34 55 89 144"),
    ("Die Mutter kauft im Laden Brot und Milch für Onkel Heinz im Dorf", "die mutter kauft im laden brot und milch für onkel heinz im dorf"),
    ("Die Mutter kauft im Laden Brot, Milch und Öl für Straße und Dorf", "DIE MUTTER KAUFT IM LADEN BROT, MILCH UND ÖL FÜR STRASSE UND DORF"),
    ("Who won 1966", "who won 1966"), ("Why?", "why?")])
def test_verbatim_copies_need_no_literals(item, text):
    ix = dec.Index([(1, "some other item that is not in the text"), (7, item)])
    leaks = ix.leaks("Before it. " + text + " And after.")
    assert [(leak[0], leak[1], leak[2]) for leak in leaks] == [(7, len(item.split()), 1.0)]
    other = " ".join("".join(chr(ord(c) + 1) if c.isalnum() else c for c in t) for t in text.split())
    assert ix.leaks(other) == []
