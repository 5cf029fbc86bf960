import math
import random
import re

import public_tokenizers as P
import sentencepiece

from lightbox.llm import fertility

PATH = P.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_base_measures(docs, odd, prose):
    texts = odd + ["a b c d e f g h " * 9, "x\nx\n \n\t\n x\nx", prose(1, 40) + "\n" + prose(1, 12), "# $ | <b> & " * 3, "a " * 8, "a " * 9, prose(4, 15) + " " + prose(5, 300) + " " + prose(4, 15)]
    rows = {r["doc_id"]: r for r in fertility.judge(docs(texts), PATH).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["kept"] and r["base_failed"])


def test_fertility_of_the_vocabulary(docs):
    text = "some words and 漢字 " * 5
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids = model.encode(text)
    row = fertility.judge(docs([text]), PATH).first()
    assert row["n_tokens"] == len(ids) and abs(row["chars_per_token"] - len(text) / len(ids)) < 1e-12
    assert abs(row["byte_share"] - sum(map(model.is_byte, ids)) / len(ids)) < 1e-12 and row["entropy"] > 2


def test_bands_reject_what_a_language_does_not_look_like(docs, prose):
    clean = [prose(k, 60 + k % 40) for k in range(300)]
    junk = [prose(900, 80).upper().replace(" ", "!! "), " ".join(w + "###" for w in prose(901, 80).split()), "qzxv jkwq " * 3 + " ".join(f"q{k}zx{k}" for k in range(60))]
    rows = {r["doc_id"]: r["kept"] for r in fertility.judge(docs(clean + junk, langs=["en"] * 300 + ["en", None, "en"]), PATH).collect()}
    assert sum(rows[i] for i in range(300)) >= 298 and not any(rows[i] for i in range(300, 303))


def test_copies_set_the_bands_once(docs, prose):
    clean = [prose(k, 60 + k % 40) for k in range(300)]
    kept = lambda texts, langs=None: {r["doc_id"]: (r["kept"], round(r["far"], 9)) for r in fertility.judge(docs(texts, langs=langs), PATH).collect()}
    alone, hot = kept(clean), kept(clean + [clean[7]] * 2000)
    assert all(hot[i] == alone[i] for i in range(300)) and all(hot[i] == alone[7] for i in range(300, 2300))
    assert sum(k for k, _ in alone.values()) >= 298
    # one text in many small languages counts once where all languages are one cell
    spread = kept(clean + [clean[7]] * 900, [f"x{k % 30}" for k in range(300)] + [f"y{k}" for k in range(900)])
    assert sum(spread[i][0] for i in range(300)) >= 298


def brute_far(rows):
    """The distances again, by plain lists: rows are dicts of measures with lang, half and digest."""
    floors = fertility.FLOORS

    def bands(usual):
        def of(part):
            out = {}
            for m, floor in floors.items():
                v = sorted(math.floor(r[m] / fertility.BINS[m]) for r in part)
                q = [(v[max(0, math.ceil(p * len(v)) - 1)] + 0.5) * fertility.BINS[m] for p in (0.25, 0.5, 0.75)]
                out[m] = (q[1], (q[2] - q[0]) / 1.349 + floor)
            return out

        once = {}
        for r in usual:
            once.setdefault(r["text"], r)

        def find(r):
            for same in (lambda x: x["lang"] == r["lang"] and x["half"] == r["half"], lambda x: x["lang"] == r["lang"] and x["half"] // 2 == r["half"] // 2, lambda x: x["lang"] == r["lang"]):
                part = [x for x in usual if same(x)]
                if len(part) >= fertility.LEAST:
                    return of(part)
            return of(list(once.values()))

        cells = {(r["lang"], r["half"]): r for r in rows}
        return {c: find(r) for c, r in cells.items()}

    def far(r, found):
        z = {m: (r[m] - found[r["lang"], r["half"]][m][0]) / found[r["lang"], r["half"]][m][1] for m in floors}
        return math.sqrt(z["chars_per_token"] ** 2 + min(z["entropy"], 0) ** 2 + max(z["byte_share"] / 2, 0) ** 2)

    usual = list({(r["lang"], r["text"]): r for r in rows if not r["base_failed"]}.values())
    for _ in range(2):
        found = bands(usual)
        usual = [r for r in usual if far(r, found) <= 4]
    found = bands(usual)
    return [far(r, found) for r in rows]


def test_verdicts_against_plain_lists(docs, prose):
    r = random.Random(6)
    texts = [prose(k, r.choice([22, 30, 31, 60, 64, 120, 300])) for k in range(420)] + [prose(900, 80).upper().replace(" ", "!! "), " ".join(w + "###" for w in prose(901, 80).split()), "a b", None]
    texts += texts[:30]
    langs = [r.choice(["en", "en", "en", "de", None, "xx"]) for _ in texts]
    rows = [x.asDict() for x in fertility.judge(docs(texts, langs=langs), PATH).collect()]
    for x in rows:
        x["text"] = texts[x["doc_id"]]
        x["half"] = int(math.floor(2 * math.log2(max(1, x["n_tokens"]))))
    for x, far in zip(rows, brute_far(rows), strict=True):
        assert abs(x["far"] - far) < 1e-6 and x["kept"] == (not x["base_failed"] and far <= fertility.BAND)
    assert 0 < sum(not x["kept"] for x in rows) < 60


def test_empty(docs):
    assert fertility.judge(docs([]), PATH).count() == 0
