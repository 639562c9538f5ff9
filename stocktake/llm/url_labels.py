"""The labelled urls that the filter's model is trained on: some thousands, made by rule from word lists.

Urls to block have a marked word in their host or in their path; urls to allow have names of
ordinary words, of invented pronounceable ones, and of words that hold a marked word by chance.
Forms, endings, languages and numbers are drawn alike for both.
"""

from __future__ import annotations

from random import Random

#: Words that mark a host or a path: gambling, drugs, adult content, advertising, piracy, fraud, link spam.
MARKED = """casino casinos poker blackjack roulette slots jackpot gambling betting bets bookie lottery sportsbook
viagra cialis levitra xanax tramadol pills meds steroid kamagra drugstore slimming
porn porno xxx sexcam sexchat adult nude nudes milf escort escorts camgirl hentai hookup erotic fetish
adserver adserv ads adclick banner popunder popups tracker track tracking clicktrack affiliate pixel doubleclick
warez crack cracked keygen torrent torrents nulled serialkey rapidleech moviez freemovies
payday quickloan loans forex binary ponzi doubler giveaway replica rolex phishing scam
spam linkfarm farm backlinks seolinks clickbait doorway autoblog""".split()
#: What marked words come with.
AROUND = "free best top win cheap online vip royal club zone world king mega super lucky gold hot live real big easy fast buy shop store hub x 24 365 777 max pro party land city star".split()
#: Ordinary words.
PLAIN = """alpha anchor apple archive author autumn bakery balance basket bicycle blossom bridge brother butter camera candle canyon castle cedar
chapter cherry city clinic cloud coast college compass copper council country courier crystal culture daily dance desert doctor dragon eagle earth east
editor energy engine falcon family farmer fashion feather festival field fire flower forest fortune fountain friend future gallery garden gazette glass
granite grammar guitar harbor harvest health heritage history home honey horizon hospital house island jasmine journal journey jungle kettle kitchen
lantern lemon letter library light linen lion local lumber magnet maple market meadow melody memory mercury meridian metro mirror monitor morning mountain
museum music nature nation network news north notebook ocean office olive opera orchard orchid oxford paper parish pepper physics piano pioneer planet
pocket poem portal prairie primary public quarter radio railway rainbow record region research ribbon river rocket sailor school science season
shadow shelter signal silver sister society south spirit spring station steam stone story studio summer sunday supply surgery swallow system table
tailor teacher temple theatre theory thread thunder ticket timber tower town tradition train travel tulip union university valley velvet village violet
voice walnut water weather weekly western whistle willow window winter wonder wood writer yellow youth""".split()
#: Ordinary words that hold a marked one, or most of it.
NEAR = """essex sussex middlesex wessex unisex sextant sexton alphabet better betty elizabeth diabetes tibet tobacco pillow pillar caterpillar spillway
soundtrack racetrack backtrack trackpad tracksuit nutcracker firecracker crackers loads roads heads beads downloads shadows adsorption gradschool
farmhouse farmers farmington farmland winery winter window winchester windsor winston freeman freedom freestone cheapside lotus lottie
analysis cocktail peacock hancock dickens dickson scunthorpe specialist socialist realist pharmacology pharmacist medsoc medstudent
adulthood adultlearning clickers bannerman bannockburn popular populace pixels affiliation torrential slotted pokerface serialisation
replicate replication laxative relaxation taxes maxwell xavier phoenix linkage linkoping spamalot crackle warehouse keyboard camera campus nudge""".split()
STARTS = "b bl br c ch cl cr d dr f fl fr g gl gr h j k kl l m n p ph pl pr qu r s sc sh sk sl sm sn sp st str sw t th thr tr tw v w wh y z".split() + [""] * 4
MIDDLES = "a e i o u a e i o ai au ea ee ei ia ie io oa oo ou".split()
ENDS = "n r l s t d m nd nt ng st th ck sh ch rd ll ss ble tion ing ed er ly or es en al an in it on re he ha ti wh".split() + [""] * 10
HEADS = ("", "", "www.", "www.", "m.", "blog.", "shop.", "en.", "static.", "my.")
TAILS = ("com", "net", "org", "info", "io", "eu", "co.uk", "de", "fr", "es", "to", "example.com", "example.net", "example.org")
LANGUAGES = ("en", "de", "fr", "es", "it")
#: Names that stay out of training: hosts of the tables that the filter is tried on.
UNSEEN = {"casino-win", "free-bets", "ads-track", "cheap-pills", "spam-farm", "adult-x"}


def invented(r: Random) -> str:
    """A pronounceable name of one to three syllables."""
    return "".join(r.choice(STARTS) + r.choice(MIDDLES) + r.choice(ENDS) for _ in range(r.choice((1, 2, 2, 2, 3))))


def ordinary(r: Random) -> str:
    kind = r.random()
    if kind < 0.5:
        return invented(r)
    if kind < 0.75:
        return r.choice(NEAR) if r.random() < 0.5 else r.choice(NEAR) + r.choice(("", "-")) + r.choice(PLAIN)
    return r.choice(("", "-")).join(r.sample(PLAIN, r.choice((1, 2, 2))))


def marked(r: Random) -> str:
    word, other, glue = r.choice(MARKED), r.choice(AROUND) if r.random() < 0.7 else r.choice(PLAIN), r.choice(("-", "-", "", "-"))
    return r.choice((word, f"{word}{glue}{other}", f"{other}{glue}{word}", f"{other}{glue}{word}", f"{word}{glue}{r.choice(MARKED)}"))


def _tail(r: Random, word: str | None) -> str:
    number = str(r.randint(1, 9999))
    parts = r.choice(([], [r.choice(LANGUAGES), number], [r.choice(LANGUAGES), number], [str(r.randint(1998, 2025)), f"{r.randint(1, 12):02d}"], [r.choice(PLAIN)], [number]))
    if word:
        parts = parts[:1] + [word] + ([number] if r.random() < 0.4 else [])
    return "/" * bool(parts) + "/".join(parts) + r.choice(("", "", ".html", "/", "?page=2", "#top"))


def labelled_urls(rows: int = 12_000, seed: int = 1) -> list[tuple[str, int]]:
    """(url, 1 to block or 0 to allow), half of each, without the names of UNSEEN; a fifth of those to block have their mark in the path."""
    r, out = Random(seed), [("", 0)] * 8
    while len(out) < rows:
        block = len(out) % 2
        in_path = r.random() < 0.2
        name = marked(r) if block and not in_path else ordinary(r)
        word = (marked(r) if block else ordinary(r)) if in_path else None
        url = f"{r.choice(('http', 'https'))}://{r.choice(HEADS)}{name}.{r.choice(TAILS)}{_tail(r, word)}"
        if not any(unseen in url for unseen in UNSEEN):
            out.append((url, block))
    return out
