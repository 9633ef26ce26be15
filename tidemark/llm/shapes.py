"""Inspected examples of prose, lists, tables and junk: where the mixture starts and what its components are called."""

from __future__ import annotations

import random

SHAPES = ("prose", "list", "table", "junk")

# Sentences, phrases and cells of the kinds that were seen in the inspected documents.
_SENTENCES = {
    "en": [
        "The team decided to keep the old setting for a week, because nobody had looked at the numbers yet.",
        "What we saw in the first trial was that the worker lost a part of the answer, and the desk noticed it only on Monday.",
        "It is a small problem, but it comes back whenever the store waits for the reader.",
        "If the service is asked to do too much, it will have dropped the request long before anyone reads the log.",
        "There was no alarm, since the field may be missing, and so the office had to check 31 cases by hand.",
        "The cost of an answer rose to 4.12 dollars, which was more than we had planned for.",
    ],
    "de": [
        "Wir haben beschlossen, die Sache noch einmal zu prüfen, und sehen uns die Zahlen in 12 Tagen wieder an.",
        "Außerdem ist der Dienst nicht so schnell, wie man es am Anfang der Woche erwartet hätte.",
        "Es war kein großer Fehler, aber das Büro musste 14 Fälle von Hand prüfen.",
    ],
    "fr": [
        "Nous avons décidé de revoir la règle et de regarder les chiffres dans 15 jours.",
        "Ce n'était pas très grave, mais le bureau a dû relire 22 dossiers à la main.",
        "Il reste à savoir si le service sera prêt à la fin de la semaine, et ce que la direction en pense.",
    ],
    "es": [
        "Hemos decidido repetir las llamadas y volver a mirar las cifras dentro de 20 días.",
        "No fue un fallo grave, pero el equipo tuvo que revisar 17 casos a mano.",
        "Todavía no se sabe si el servicio estará listo al final de la semana, ni qué opina la oficina.",
    ],
}
_PHRASES = {
    "en": ["the second answer", "ask for a review", "the stale row (optional)", "our help desk", "the nightly check", "keep the old text for ten days", "every cached prompt x3", "the data office: the reader", "write the decision down"],
    "de": ["die zweite Antwort", "unser Kundendienst", "die Einstellung ändern", "das Protokoll", "die Kosten messen (optional)"],
    "fr": ["la deuxième réponse", "le bureau des données", "ne rien changer", "relire les dossiers (optional)", "l'équipe de contrôle"],
    "es": ["la segunda respuesta", "la oficina de datos", "dejar el ajuste como está", "repetir las llamadas", "el lector x2"],
}
_CELLS = ["48.12", "late", "7730", "n/a", "ok", "—", "marlin-2-mini", "office", "3.5", "answer", "", "512", "desk", "marlin-pro", "61.07", "reader"]
_HEADS = ["model", "owner", "calls", "status", "usd", "day", "ratio"]
_PAGE = ["Home", "Menu", "Login", "Next", "Prev", "Share", "Help", "FAQ", "EN", "DE", "Terms", "Cookies", "Cart", "Top"]


def _wrapped(text: str, width: int) -> str:
    lines, line = [], ""
    for word in text.split():
        if line and len(line) + 1 + len(word) > width:
            lines.append(line)
            line = word
        else:
            line = f"{line} {word}".strip()
    return "\n".join([*lines, line])


def examples(seed: int = 7) -> list[tuple[str, str, str]]:
    """(component, shape, text): several texts of each kind that was seen, put together from the values above."""
    rng = random.Random(seed)
    out: list[tuple[str, str, str]] = []
    text = lambda lang, n: " ".join(rng.choice(_SENTENCES[lang]) for _ in range(n))
    add = lambda component, shape, body: out.append((component, shape, body))
    cells = lambda n: [rng.choice(_CELLS) for _ in range(n)]
    heads = lambda n: [rng.choice(_HEADS) for _ in range(n)]
    for lang in _SENTENCES:
        for n in (3, 6, 12):
            add("paragraphs", "prose", "\n\n".join(text(lang, max(2, n // 3)) for _ in range(max(1, n // 3))))
        for width in (50, 64, 78):
            add("wrapped", "prose", _wrapped(text(lang, 7), width))
        add("short", "prose", text(lang, 1))
        add("short", "prose", text(lang, 2))
        bare = lambda lang, n: text(lang, n).lower().replace(".", "").replace(",", "")
        for n in (2, 5, 9):
            add("unpunctuated", "prose", bare(lang, n))
            add("unpunctuated", "prose", "\n\n".join(bare(lang, n) for _ in range(3)))
            few = "\n".join(f"{mark} {p}" for mark, p in zip(("-", "-", "-") if n > 2 else ("1.", "2.", "3."), rng.sample(_PHRASES[lang], 3), strict=True))
            add("unpunctuated mixed", "prose", f"{bare(lang, n)}\n\n{few}\n\n{bare(lang, n)}")
        short_list = "\n".join(f"- {p}" for p in rng.sample(_PHRASES[lang], 3))
        add("mixed", "prose", f"{text(lang, 4)}\n\n{short_list}\n\n{text(lang, 5)}\n\n{text(lang, 3)}")
        add("mixed", "prose", f"# {rng.choice(_PHRASES[lang]).title()}\n\n{text(lang, 4)}\n\n{text(lang, 4)}\n\n{text(lang, 3)}")
        for mark in ("- {}", "* {}", "{i}. {}", "{i}) {}", "[ ] {}", "• {}", "– {}", "  - {}", "Step {i}: {}"):
            n = rng.choice((8, 14, 22))
            items = [mark.format(rng.choice(_PHRASES[lang]), i=i + 1) for i in range(n)]
            add("items", "list", rng.choice(("\n", "\n\n")).join(items))
            full = [mark.format(rng.choice(_SENTENCES[lang]) if rng.random() < 0.7 else rng.choice(_PHRASES[lang]), i=i + 1) for i in range(n // 2 + 3)]
            add("sentence items", "list", rng.choice(("\n", "\n\n")).join(full))
            add("introduced items", "list", f"{rng.choice(_SENTENCES[lang])[:-1]}:\n" + "\n".join(items))
        for n in (8, 15):
            add("bare items", "list", "\n".join(rng.choice(_PHRASES[lang]) for _ in range(n)))
            add("bare items", "list", f"{rng.choice(_SENTENCES[lang])[:-1]}:\n" + "\n".join(rng.choice(_PHRASES[lang]) for _ in range(n)))
    for i in range(6):
        n, rows = 3 + i % 4, 8 + 3 * i
        body = [heads(n), *(cells(n) for _ in range(rows))]
        intro = f"{rng.choice(_SENTENCES['en'])}\n" if i % 3 == 2 else ""
        pipes = ["| " + " | ".join(r) + " |" for r in body]
        add("pipe table", "table", intro + "\n".join([pipes[0], "|" + "---|" * n, *pipes[1:]]))
        rule = "+" + ("-" * 14 + "+") * n
        add("ruled table", "table", intro + "\n".join([rule, *("|" + "|".join(c.center(14) for c in r) + "|" for r in body), rule]))
        add("separated", "table", intro + "\n".join("\t".join(r) for r in body))
        add("separated", "table", intro + "\n".join(";".join(r) for r in body))
        add("separated", "table", intro + "\n".join(",".join(f'"{c}"' if rng.random() < 0.2 else c for c in r) for r in body))
        add("columns", "table", intro + "\n".join("".join(c.ljust(16) for c in r).rstrip() for r in body))
        names = heads(3)
        add("pairs", "table", intro + "\n".join(f"{names[j % 3]:<10}: {rng.choice(_CELLS)}" for j in range(9 + 3 * i)))
        alnum = "abcdefghijklmnopqrstuvwxyz0123456789"
        code = lambda m, a=alnum + alnum[:26].upper() + "+/": "".join(rng.choice(a) for _ in range(m))
        add("encoded", "junk", "\n".join(code(76) for _ in range(6 + 3 * i)))
        add("encoded", "junk", code(400 + 100 * i))
        add("noise words", "junk", " ".join(code(rng.randint(3, 20), alnum) for _ in range(40 + 10 * i)))
        add("noise signs", "junk", "\n".join("".join(rng.choice("<>|{}[]~^#*%&/\\=+_-:;?!@§¶†‡□■◆¤…  ") for _ in range(rng.randint(3, 70))) for _ in range(6 + 2 * i)))
        add("page", "junk", (" | " if i % 2 else " ").join(rng.choice(_PAGE) for _ in range(60 + 20 * i)))
        garbled = "".join(c if rng.random() < 0.55 else rng.choice("ÂÃâ€¿½�?") for c in text(rng.choice(list(_SENTENCES)), 4))
        add("garbled", "junk", garbled)
        stamps = [f"2026-04-{rng.randint(10, 28)}T{rng.randint(10, 23)}:{rng.randint(10, 59)}:02Z {rng.choice(('INFO', 'WARN', 'DEBUG'))} worker-{rng.randint(1, 40)} open id={code(12, '0123456789abcdef')} took={rng.randint(10, 9000)}ms" for _ in range(8 + 3 * i)]
        add("log", "junk", "\n".join(stamps))
        record = lambda: {"id": code(8, "0123456789abcdef"), "usage": {"input_tokens": rng.randint(100, 5000), "output_tokens": rng.randint(10, 400)}, "ok": rng.random() < 0.5}
        add("dump line", "junk", str([record() for _ in range(3 + i)]).replace("'", '"').replace("True", "true").replace("False", "false"))
        import json

        add("dump lines", "junk", json.dumps([record() for _ in range(2 + i)], indent=2))
        phrase = rng.choice(_PHRASES["en"] + _PHRASES["de"])
        add("repeated lines", "junk", "\n".join([phrase] * (15 + 5 * i)))
        sentence = rng.choice(_SENTENCES[("en", "de", "fr", "es")[i % 4]])
        add("repeated sentence lines", "junk", "\n".join([sentence if i % 3 else "Press to go on."] * (10 + 5 * i)))
        add("repeated run", "junk", " ".join([phrase] * (15 + 5 * i)))
        add("repeated sentence run", "junk", " ".join([sentence if i % 3 else "Press to go on."] * (10 + 5 * i)))
    return out
