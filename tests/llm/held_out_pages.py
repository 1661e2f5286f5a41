"""Pages of sites that no training page is made like, with the blocks of their articles."""

STORY = [
    "Stadtrat beschließt neue Brücke über den Fluss",
    "Nach langer Debatte hat der Stadtrat am Dienstag den Bau einer zweiten Brücke beschlossen, die ab dem Frühjahr entstehen soll.",
    "Die Kosten werden auf rund zwölf Millionen Euro geschätzt.",
    "Was geplant ist",
    "eine Spur für Radfahrer",
    "zwei Spuren für Autos",
    "Wir haben lange auf diesen Tag gewartet, sagte die Bürgermeisterin nach der Sitzung.",
    "Die alte Brücke im Winter",
    "Bauabschnitt",
    "Dauer",
    "Pfeiler",
    "acht Monate",
    "Der Verkehr wird während der Arbeiten über die nördliche Umgehung geleitet, teilte die Verwaltung mit.",
]


def story(head: str = "{}", quote: str = "<blockquote>{}</blockquote>") -> str:
    s = STORY
    return (
        head.format(f"<h1>{s[0]}</h1>") + f"<p>{s[1]}</p><p>{s[2]}</p><h2>{s[3]}</h2><ul><li>{s[4]}</li><li>{s[5]}</li></ul>" + quote.format(s[6])
        + f"<figure><img src='b.jpg'><figcaption>{s[7]}</figcaption></figure><table><tr><th>{s[8]}</th><th>{s[9]}</th></tr>"
        f"<tr><td>{s[10]}</td><td>{s[11]}</td></tr></table><p>{s[12]}</p>"
    )


MENU = "<ul><li><a href='/'>Start</a></li><li><a href='/p'>Politik</a></li><li><a href='/s'>Sport</a></li></ul>"
TALK = (
    "<div>Bernd K.</div><div>Das wurde auch Zeit, ich stehe jeden Morgen im Stau!</div>"
    "<div>Anna</div><div>Und wer soll das alles bezahlen?</div>"
)

PAGES = [
    (
        "sectioned",
        f"<html><body><header><a href='/'>Tagesbote</a><nav>{MENU}</nav></header><main><article>{story('<header>{}</header>')}</article></main>"
        "<aside><h3>Meistgelesen</h3><ul><li><a href='/1'>Neues Freibad</a></li></ul></aside><footer><p>© Tagesbote Verlag</p></footer></body></html>",
        STORY,
    ),
    (
        "unknown names",
        f"<html><body><div class='kopfzeile'><a href='/'>Tagesbote</a>{MENU}</div><div class='inhalt'>{story()}</div>"
        "<div class='seitenleiste'><h3>Meistgelesen</h3><p>Das neue Freibad öffnet im Mai seine Türen.</p></div>"
        "<div class='fusszeile'>© Tagesbote Verlag, alle Rechte vorbehalten.</div></body></html>",
        STORY,
    ),
    (
        "comments in unmarked containers",
        f"<html><body><nav>{MENU}</nav><article>{story()}</article><div>{TALK}</div><footer>Impressum</footer></body></html>",
        STORY,
    ),
    (
        "quote in paragraphs",
        f"<body><div id='hdr'><p>Tagesbote</p></div><article class='art-9'>{story('<header>{}</header>', '<blockquote><p>{}</p></blockquote>')}"
        "<div class='advert'><p>Jetzt günstig Winterreifen kaufen.</p></div></article><form><label>Ihre Adresse</label><button>Senden</button></form></body>",
        STORY,
    ),
]
