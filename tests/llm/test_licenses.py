import random

from epsgroup.llm import licenses

TEMPLATES = (("long", "alpha beta gamma delta alpha epsilon zeta the eta theta the iota kappa lambda mu nu xi omicron pi rho"), ("short", "all rights reserved."))


def brute(text, template):
    """Longest common subsequence: no alignment can cover more."""
    row = [0] * (len(template) + 1)
    for x in text:
        last = 0
        for j, y in enumerate(template, 1):
            last, row[j] = row[j], max(row[j], row[j - 1], last + 1 if x == y else 0)
    return row[-1]


def test_increasing():
    r = random.Random(0)
    for _ in range(50):
        values = r.sample(range(100), r.randint(0, 20))
        places = licenses.increasing(values)
        own = [values[p] for p in places]
        assert own == sorted(own) and places == sorted(places)
        best = [1] * len(values)
        for i in range(len(values)):
            best[i] = 1 + max((best[j] for j in range(i) if values[j] < values[i]), default=0)
        assert len(own) == max(best, default=0)


def test_align_is_a_common_subsequence():
    r = random.Random(1)
    for _ in range(200):
        a, b = (r.choices("abcdefghij", k=r.randint(0, 25)) for _ in range(2))
        found = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in found) and len(found) <= brute(a, b)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))
        assert len(licenses.align(b, b)) == len(b)


def test_scan(frame):
    long = TEMPLATES[0][1]
    words = long.split()
    docs = [
        (1, f"some text {long.upper()} and more"), (2, None), (3, ""), (4, long + " " + long), (5, " ".join(words[:10] + ["new"] + words[10:])),
        (6, " ".join(words[:-2])), (7, " ".join(words[:-3])), (8, " ".join(reversed(words))), (None, f"x\nAll Rights\treserved."), (1, "all rights reserved"),
        (9, "the all of rights " * 20000 + long), (10, "all rights reserved. " * 50),
    ]
    table = frame(docs, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["license"], round(r["coverage"], 3)) for r in licenses.scan(table, "doc_id", "text", TEMPLATES).collect()), key=str)
    want = [(1, "long", 1.0), (4, "long", 1.0), (5, "long", 1.0), (6, "long", 0.9), (None, "short", 1.0), (9, "long", 1.0), (10, "short", 1.0)]
    assert got == sorted(want, key=str)
    place = licenses.scan(table.where("doc_id = 1"), "doc_id", "text", TEMPLATES).first()
    assert (place["first_word"], place["end_word"]) == (2, 2 + len(words))
    assert licenses.scan(table.limit(0), "doc_id", "text").count() == 0


def test_every_template_covers_itself(frame):
    docs = [(i, f"before\n{text}\nafter") for i, (_, text) in enumerate(licenses.TEMPLATES)]
    got = {(r["doc_id"], r["template"]): r["coverage"] for r in licenses.scan(frame(docs, "doc_id long, text string"), "doc_id", "text").collect()}
    assert all(got[i, i] == 1.0 for i in range(len(docs)))


def names(frame, texts):
    """Licenses found in each text."""
    rows = licenses.scan(frame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").collect()
    return [sorted({r["license"] for r in rows if r["doc_id"] == i}) for i in range(len(texts))]


def test_siblings_are_told_apart(frame):
    texts = [f"before\n{text}\nafter" for _, text in licenses.TEMPLATES]
    assert names(frame, texts) == [[name] for name, _ in licenses.TEMPLATES]
    gpl, cc = "This work is licensed under the GNU General Public License, version", "This work is licensed under a Creative Commons Attribution"
    long_gpl = next(text for name, text in licenses.TEMPLATES if text.startswith("This program is free"))
    bsd = dict(licenses.TEMPLATES)["BSD-3-Clause"]
    others = [f"{gpl} 2.", f"{gpl} 3+.", f"{gpl} 3 or newer.", f"{gpl} 3, or any later version", f"{cc}-NoDerivatives 4.0 International License.", f"{cc} 3.0 International License."]
    others += [f"{cc}-NonCommercial-ShareAlike 4.0 International License.", "Licensed under CC BY-ND 4.0.", "Licensed under the Apache License, Version 1.1."]
    others += [long_gpl.replace("version 3", "version 2"), long_gpl.replace("GNU General", "GNU Lesser General"), gpl.replace("GNU", "GNU Affero") + " 3."]
    others += [bsd.split("met:")[0] + "met:", bsd.replace("THIS SOFTWARE IS", "NO PATENT RIGHTS ARE GRANTED. THIS SOFTWARE IS", 1)]
    assert names(frame, others) == [[] for _ in others]


def test_signs_lists_and_short_notices(frame):
    two, three = dict(licenses.TEMPLATES)["BSD-2-Clause"], dict(licenses.TEMPLATES)["BSD-3-Clause"]
    listed = three.replace("Redistributions of", "\n 1. Redistributions of").replace("Redistributions in", "\n 2. Redistributions in").replace("Neither", "\n 3. Neither")
    texts = {
        "(Licensed under CC BY 4.0)": ["CC-BY-4.0"], "licensed under cc by 4.0; see": ["CC-BY-4.0"], "Released under MIT License": ["MIT"],
        "It is under the MIT License!": ["MIT"], "\u201call rights reserved\u201d": ["LicenseRef-all-rights-reserved"], "all my rights reserved": [],
        "# Licensed under the\n# Apache License,\n# Version 2.0 and": ["Apache-2.0"],
        "\n".join(f" * {line}" for line in listed.splitlines()): ["BSD-3-Clause"], f"{three}\n\n{two}": ["BSD-2-Clause", "BSD-3-Clause"],
        "Licensed under CC BY 4.0. Released under the MIT License. Licensed under CC BY-NC 4.0.": ["CC-BY-4.0", "CC-BY-NC-4.0", "MIT"],
    }
    assert names(frame, texts) == list(texts.values())
    place = licenses.scan(frame([(1, "-- * x, -- (Licensed under CC BY 4.0) !")], "doc_id long, text string"), "doc_id", "text").first()
    assert (place["first_word"], place["end_word"]) == (4, 9)
