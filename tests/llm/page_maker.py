"""Pages of many layouts with known blocks, for fitting and for testing the page classifier."""

import random
import re
import zlib

SOUNDS = "an en er in on re st th ti le la de ou qu ch al ier eau sch ung el os ar ion".split()
SMALL = "the of and to in is that la le de et un der die und das el los que y".split()


class Maker:
    """One page: html, and for each block its text and whether it is content."""

    def __init__(self, rng: random.Random):
        self.rng, self.blocks, self.n = rng, [], 0

    def word(self) -> str:
        return self.rng.choice(SMALL) if self.rng.random() < 0.35 else "".join(self.rng.choices(SOUNDS, k=self.rng.randint(1, 4)))

    def text(self, lo: int, hi: int, content: bool, end: str = ".") -> str:
        """Text of a block of its own; a number that no other block has tells it from others."""
        self.n += 1
        words = [self.word() for _ in range(self.rng.randint(lo, hi))]
        for k in range(8, len(words), 11):
            words[k] += self.rng.choice([",", ".", "."])
        text = " ".join([*words, str(self.n) + end]).capitalize()
        self.blocks.append((text, content))
        return text

    def prose(self, content: bool = True) -> str:
        longest = self.rng.choice([6, 25, 60, 120])
        return self.text(1, longest, content)

    def links(self, k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{self.text(1, 3, False, "")}</a></li>' for i in range(k)) + "</ul>"

    def body(self) -> str:
        rng, out = self.rng, [f"<h1>{self.text(2, 12, True, '')}</h1>"]
        if rng.random() < 0.4:
            out.append(f'<p class="byline">{self.text(2, 5, True, "")}</p>')
        for _ in range(rng.choice([1, 2, 4, 8, 15, 30])):
            kind = rng.random()
            if kind < 0.72:
                out.append(f"<p>{self.prose()}</p>")
            elif kind < 0.80:
                out.append(f"<h2>{self.text(2, 7, True, '')}</h2><p>{self.prose()}</p>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{self.text(4, 20, True)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.91:
                out.append(f"<blockquote><p>{self.prose()}</p></blockquote>")
            elif kind < 0.95:
                out.append("<table>" + "".join(f"<tr><td>{self.text(1, 3, True, '')}</td><td>{self.text(1, 3, True, '')}</td></tr>" for _ in range(rng.randint(2, 4))) + "</table>")
            elif kind < 0.98:
                out.append(f'<div class="ad">{self.text(2, 12, False)}</div>')
            else:
                out.append(f'<div class="share">{self.links(3)}</div>')
        return "".join(out)

    def page(self) -> str:
        rng = self.rng
        head = '<head><meta charset="utf-8"><title>x y</title><style>p{}</style><script>var t="</p>";</script></head>'
        top, bottom = [], []
        if rng.random() < 0.6:
            top.append(f'<header class="masthead"><a href="/">{self.text(1, 3, False, "")}</a></header>')
        if rng.random() < 0.9:
            top.append(f"<nav>{self.links(rng.randint(3, 10))}</nav>")
        if rng.random() < 0.4:
            top.append(f'<div class="cookie-notice">{self.text(6, 25, False)} <a href="/c">{rng.choice(["OK", "More"])}</a></div>')
            text, _ = self.blocks.pop()
            self.blocks.append((text + " " + ("OK" if ">OK<" in top[-1] else "More"), False))
        if rng.random() < 0.6:
            top.append(f'<div class="ad">{self.text(3, 15, False)}</div>')
        side = ""
        if rng.random() < 0.4:
            side = f'<aside class="sidebar"><h3>{self.text(1, 3, False, "")}</h3>{self.links(rng.randint(3, 8))}<p>{self.text(4, 14, False)}</p></aside>'
        own = self.body()
        comments = ""
        if rng.random() < 0.3:
            longest = rng.choice([8, 30, 90])
            if rng.random() < 0.5:
                each = [f'<div class="comment"><p>{self.text(1, 2, False, "")}</p><p>{self.text(4, longest, False)}</p></div>' for _ in range(rng.randint(1, 5))]
            else:
                each = [f"<p>{self.text(4, longest, False)}</p>" for _ in range(rng.randint(1, 6))]
            comments = f'<section class="comments">{"".join(each)}</section>'
        if rng.random() < 0.25:
            bottom.append(f'<form class="newsletter"><label>{self.text(3, 8, False)}</label><input name="m"></form>')
        if rng.random() < 0.35:
            bottom.append(f'<div class="related"><h3>{self.text(1, 3, False, "")}</h3>{self.links(rng.randint(3, 6))}</div>')
        if rng.random() < 0.9:
            bottom.append(f"<footer>{self.text(3, 14, False)}</footer>")
        shape = rng.random()
        if shape < 0.5:
            main = f"<article>{own}{comments}</article>" if rng.random() < 0.5 else f"<article>{own}</article>{comments}"
        elif shape < 0.8:
            main = f'<main><div class="content">{own}</div>{comments}</main>'
        else:
            main = f'<div id="page"><div class="post">{own}</div>{comments}</div>'
        left = side and rng.random() < 0.5
        # Their blocks stand in page order, whatever order they were made in.
        return f"<!DOCTYPE html><html>{head}<body>{''.join(top)}{side if left else ''}{main}{'' if left else side}{''.join(bottom)}</body></html>"


def made(seed: int) -> tuple[str, dict[str, bool]]:
    """A page, and its blocks: text to whether it is content."""
    maker = Maker(random.Random(seed))
    return maker.page(), dict(maker.blocks)


def blinded(html: str, seed: int = 0) -> str:
    """html with class, id and role values that say nothing, and telling elements as plain divisions."""
    html = re.sub(r'\b(class|id|role)="[^"]*"', lambda m: f'{m[1]}="x{zlib.crc32(f"{seed}{m[0]}".encode())}"', html)
    return re.sub(r"<(/?)(article|main|nav|footer|aside|header|section|form)\b", r"<\1div", html)


def main_text(html: str, truth: dict[str, bool]) -> str:
    """The content blocks in page order."""
    places = sorted((html.index(t if t in html else t.rsplit(" ", 1)[0]), t) for t, y in truth.items() if y)
    return " ".join(t for _, t in places)
