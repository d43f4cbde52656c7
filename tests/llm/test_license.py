import random
import re

from calibra.llm import license as lic

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = WORDS.findall(low)
    at, labels = [], set()
    for p, label in lic.PHRASES.items():
        p = p.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), sorted(labels)


def corpus():
    rng = random.Random(8)
    filler = lambda n: " ".join(rng.choice("the of and to in word other text é1 ß".split()) for _ in range(n))
    texts, want = [None, "", "!!!", "under the MIT\nlicense", "xunder the mit license", "under the mit license under the MIT-License!",
                    "CC BY-NC CC BY NC cc by", "Apache License, Version 2.0", "a b a b a", filler(3000)], {}
    for label, notice, _ in lic.TEMPLATES:
        words = notice.split()
        texts.append(filler(40) + " " + notice + " " + filler(30))
        want[len(texts) - 1] = label
        if len(words) > 20:  # a word exchanged and one lost
            words[len(words) // 2] = "changed"
            texts.append(filler(10) + " " + " ".join(words[:-1]))
            want[len(texts) - 1] = label
    return texts + [filler(200) for _ in range(60)], want


def test_base_columns_and_labels(frame):
    texts, want = corpus()
    rows = {r.doc_id: r for r in lic.scan_documents(frame(texts, clash=("labels", "score"))).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(t), t
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        if i in want:
            assert want[i] in r.labels, t
        elif not r.base_labels:
            assert r.labels == [], t


def test_mandatory_phrases_decide():
    index = lic.Index()
    index.weigh({b"the": 90, b"of": 90}, 100)
    notice = next(t for t in lic.TEMPLATES if t[0] == "bsd")[1]
    assert "bsd" in index.scan(lic.words(notice))
    assert "bsd" not in index.scan(lic.words(notice.replace("source and binary", "binary and source")))


def test_empty_table(frame):
    assert lic.scan_documents(frame([])).collect() == []


def all_alignments(index, file):
    out = {}
    for k, label in enumerate(index.labels):
        for shift in range(-len(index.texts[k]) - lic.SLACK, len(file) + lic.SLACK + 1):
            score = index.verify(file, k, shift)
            if score >= lic.SCORE:
                out[label] = max(out.get(label, 0.0), score)
    return out


def test_shortened_notices_match_a_scan_of_all_alignments():
    """Head, middle and tail of every notice, with words lost, changed and put in, in a corpus where the words that
    most copies lack are the rare ones."""
    rng = random.Random(21)
    files = []
    for _, notice, _ in lic.TEMPLATES:
        w = lic.words(notice)
        n = max(1, round(len(w) * rng.uniform(0.75, 0.85)))
        for cut in (w, w[:n], w[len(w) - n:], w[(len(w) - n) // 2:][:n], w[:round(len(w) * 0.7)]):
            for errors in (0, 1, 3):
                cut = list(cut)
                for _ in range(errors):
                    at = rng.randrange(len(cut))
                    cut[at:at + rng.randint(0, 1)] = rng.choice([[], [b"changed"], [rng.choice(w)]])
                around = [rng.choice(lic.words("the software to copy use license of and publish terms")) for _ in range(20)]
                files.append(around[:rng.randint(0, 20)] + cut + around[:rng.randint(0, 20)])
    index = lic.Index()
    index.weigh({w: sum(w in f for f in files) for w in index.vocabulary}, len(files))
    for f in files:
        assert index.scan(f) == all_alignments(index, f), b" ".join(f)


def test_words_that_most_copies_lack_are_not_required(frame):
    head = lic.TEMPLATES[0][1].split(" publish,")[0]
    prose = "They publish and distribute books, sublicense rights and sell copies."
    rows = lic.scan_documents(frame([head + "."] * 30 + [prose] * 3)).collect()
    assert all(r.labels == (["mit"] if r.doc_id < 30 else []) for r in rows)
