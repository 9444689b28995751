"""Made-up passages with labelled personal information, for the training of the tagger.

Names, streets, towns and words are drawn from short lists or put together from syllables; numbers follow the
forms of many countries with random digits. Passages are sentences of letters, notes, forms, chats and logs in four
languages, with as many sentences that hold numbers and names of things which are nobody's personal data. Half of them
follow no template: words of a language and made-up words in random order, with spans anywhere between them, so that
the form of a span and the word before it count and not the sentence.
"""

from __future__ import annotations

import re

import numpy as np

# Material for names, towns and streets.
GIVEN = (
    "Anna Maria Lucas Noah Emma Olivia Liam Sofia Mateo Hugo Louise Jules Camille Chloé Léa Antoine Élodie Benoît Jürgen Björn Ulrike Heike Katrin Stefan Matthias Günther Hannah "
    "Mohammed Fatima Aisha Omar Yusuf Leila Ahmed Priya Rahul Anjali Sanjay Wei Li Xin Mei Hiroshi Yuki Kenji Sakura Minh Linh Thu Ngozi Chinedu Kwame Amara Zanele Thabo Ivan "
    "Olga Dmitri Svetlana Piotr Agnieszka Katarzyna Zoltán Ilona Eszter João Inês Tiago Beatriz Carlos José María Lucía Álvaro Begoña Iñaki Ximena Giulia Matteo Francesca Lars Ingrid "
    "Freja Mikkel Aino Jukka Siobhán Declan Niamh Rhys Cerys Fiona Hamish George Margaret Walter Dorothy Harold Edith Frank Ruth Tyler Brittany DeShawn Keisha Abdul Noor Sven Anke"
).split()
FAMILY = (
    "Smith Jones Taylor Brown Okafor Mensah Dlamini Nkosi Nguyen Tran Pham Li Wu Chen Wang Zhang Kim Park Ito Sato Tanaka Suzuki Singh Patel Sharma Gupta Khan Hussain Rahman "
    "Müller Schmidt Schneider Fischer Weber Wagner Becker Schulz Hoffmann Krüger Köhler Weiß Lefèvre Dubois Moreau Girard Rousseau Fournier Mercier Gauthier Perrot García Fernández "
    "González Rodríguez López Martínez Sánchez Pérez Muñoz Ibáñez Núñez Rossi Ferrari Bianchi Silva Santos Oliveira Costa Kowalski Nowak Wójcik Novák Horváth Popescu Ivanov Petrova "
    "Smirnov Andersson Johansson Nilsen Hansen Korhonen Virtanen O'Brien O'Neill MacDonald McCarthy Fitzgerald Byrne Walsh Evans Llewellyn Whitaker Thornbury Ashcroft Goldberg Cohen Levy "
    "Yilmaz Demir Haddad Nasser Rezaei Abebe Mwangi Diallo Traoré Baptiste Castillo Herrera Quispe Mamani Ng Oh Xu Fu Ma Ho Ek Ax"
).split()
PARTICLES = ["van der", "von", "de la", "van", "de", "da", "del", "di", "Le", "El", "bin", "zu"]
TOWNS = (
    "Springfield Riverton Ashford Lakewood Northfield Millbrook Harwick Stonehaven Eastleigh Fairview Cedarville Kingsbridge Lyon Nantes Rennes Besançon Montpellier Annecy Saint-Malo "
    "Köln München Leipzig Görlitz Freiburg Oldenburg Bad-Homburg Sevilla Málaga Burgos Zaragoza Alcalá Cáceres Winterhaven Oakdale Bergen Malmö Tampere Gdańsk Brno Győr"
).split()
STREET_WORDS = "Oak Maple Birch Church Station Mill Park King Queen Victoria High Bridge Garden Harbour Meadow Chapel Forge Orchard Willow Elm Castle School Tannery Abbey Quarry".split()
EN_KINDS = ["Street", "St", "St.", "Road", "Rd", "Rd.", "Avenue", "Ave", "Ave.", "Lane", "Ln", "Drive", "Dr", "Close", "Court", "Ct", "Way", "Terrace", "Row", "Boulevard", "Blvd", "Place", "Square", "Crescent", "Hill", "Gardens"]
FR_KINDS = ["rue", "Rue", "avenue", "boulevard", "bd", "chemin", "impasse", "place", "quai", "allée", "route", "cours"]
FR_NAMES = ["des Lilas", "du Moulin", "de la Gare", "Victor Hugo", "des Écoles", "de l'Église", "du Général Leclerc", "Pasteur", "des Trois Fontaines", "Saint-Martin", "du Port", "de Bretagne", "aux Herbes"]
DE_KINDS = ["straße", "str.", "weg", "gasse", "platz", "allee", "ring", "ufer", "damm", "hof", "steig", "kamp"]
DE_STEMS = ["Haupt", "Bahnhof", "Garten", "Linden", "Schiller", "Goethe", "Mühlen", "Kirch", "Berg", "Wald", "Rosen", "Birken", "Schul", "Park", "Ziegel", "Amsel"]
DE_WHOLE = ["Am Markt", "An der Aue", "Im Winkel", "Zum Alten Zoll", "Alte Gasse", "Unter den Eichen", "Auf dem Berg", "Zur Linde"]
ES_KINDS = ["Calle", "C/", "Avda.", "Avenida", "Plaza", "Paseo", "Camino", "Ronda"]
ES_NAMES = ["Mayor", "de la Paz", "del Sol", "San Juan", "de Alcalá", "de los Olivos", "del Río", "Cervantes", "de las Flores", "Nueva", "de la Iglesia", "Colón"]
HOSTS = ["example", "mail", "post", "inbox", "fastnet", "uni", "clinic", "office", "corp", "my-mail", "praxis", "hopital", "salud", "lab7", "north.health", "web"]
ENDS = ["com", "org", "net", "de", "fr", "es", "co.uk", "edu", "io", "test", "invalid", "eu", "info", "gov"]

# Frequent words of each language, and words that stand before a span or before a number of no person.
COMMON = {
    "en": "the of and to in a is was for with that on by from this not are be as at it which were had has after before when about into than over we you i she he they will would can could has been there their our your all one two new old last first next same other some any no only very then also but or if please found made came went took gave sent read said called used left seen".split(),
    "fr": "le la les de des du et à un une en est pour que qui dans sur par au avec ne pas plus ce cette il elle nous vous sont été avait être fait mais ou où si leur leurs son sa ses notre votre après avant comme aussi très bien encore deux trois nouveau dernière même tout sans sous entre chez vers depuis selon".split(),
    "de": "der die das und in zu den von mit ist im für auf des dem ein eine nicht als auch es an sich bei nach aus wird wurde sind war hat haben noch nur oder aber wenn über vor bis durch zum zur einer eines sehr dann mehr schon zwei drei neue alte letzte erste gleiche andere kein keine man wir sie er ihr gegen ohne um seit".split(),
    "es": "el la los las de del y en un una que es por con para no se al lo como más pero sus le ya o este esta sí porque muy sin sobre también me hasta hay donde quien desde todo nos durante uno dos tres ni contra otros ese eso ante ellos e esto antes algunos nuevo último mismo fue ha era son está".split(),
}
CUES = {
    "person": ["", "", "", "", "", "name", "Name:", "signed", "Signed:", "from", "by", "with", "contact", "Contact:", "dear", "Dear", "Hi", "Hello", "Bonjour", "Hola", "Hallo", "Liebe", "Regards,", "thanks,", "i am", "my name is", "its", "nom :", "von", "para", "pour", "attn", "holder", "witness", "To:", "From:"],
    "title": ["Mr", "Mr.", "Mrs", "Mrs.", "Ms", "Ms.", "Miss", "Dr", "Dr.", "Prof.", "Professor", "Sir", "Mme", "Madame", "M.", "Monsieur", "Mlle", "Herr", "Herrn", "Frau", "Sr.", "Sra.", "señor", "señora", "Don", "Doña", "Frau Dr.", "Dra."],
    "email": ["", "", "", "email", "Email:", "e-mail", "mail", "write to", "at", "an", "à", "contact", "<", "courriel", "correo"],
    "phone": ["tel", "Tel.", "Tel:", "phone", "Phone:", "call", "on", "ring", "mobile", "cell", "number is", "fax", "tél.", "au", "unter", "Telefon", "Handy", "teléfono", "al", "móvil", "reach me on", "text", "dial", "("],
    "id_number": ["passport", "passport no.", "passport number", "SSN", "social security number", "NHS number", "MRN", "MRN:", "patient ID", "patient no.", "member ID", "insurance no.", "policy holder", "medical record", "licence no.", "ID card", "passeport n°", "NIR", "n° de sécurité sociale",
        "carte d'identité", "Ausweis", "Personalausweis", "Reisepass", "Versichertennummer", "Patienten-ID", "DNI", "NIE", "con DNI", "pasaporte", "tarjeta sanitaria", "subscriber", "health card", "tax ID of the person"],
    "address": ["", "", "", "at", "lives at", "address:", "Address", "to", "moved to", "resides at", "flat at", "house at", "demeurant", "habite", "adresse :", "wohnhaft", "wohnt", "Anschrift", "in der", "vive en", "domicilio", "dirección:", "home:"],
    "none": ["order", "order no.", "lot", "batch", "invoice", "ref", "ref.", "reference", "item", "ticket", "docket", "case", "flight", "identifier", "checksum", "version", "build", "seed", "study", "grant", "serial", "room", "page", "chapter", "concept", "code", "table", "rows", "commande", "lot n°",
        "facture", "dossier technique", "train", "Bestellung", "Charge", "Rechnung", "Raum", "Artikel", "pedido", "lote", "factura", "sala", "informe", "tracking", "part no.", "NCT", "resolution", "paid", "total", "of", "about", "desk", "bus", "gate", "account plan", "="],
    "thing": ["score", "index", "test", "scale", "sign", "Hospital", "hospital", "Ward", "clinic", "theorem", "law", "syndrome", "protocol", "Street Station", "group", "Institute", "Foundation", "University", "effect", "filter", "method", "Bridge", "Award", "study", "trial", "Ltd", "Inc.", "GmbH", "S.A."],
}

HEADS, VOWELS, TAILS = "b br c ch d dr f fl g gr h j k kl l m n p pr qu r s st t th tr v w z".split(), "a e i o u ai ea ia oo".split(), "n r l s m th rd lt nd ck x tt ll".split()


class Maker:
    """Draws passages; everything comes from one random generator."""

    def __init__(self, rng: np.random.Generator):
        self.rng = rng

    def one(self, items):
        return items[int(self.rng.integers(len(items)))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def digits(self, n: int) -> str:
        return "".join(str(d) for d in self.rng.integers(0, 10, n))

    def fill(self, form: str) -> str:
        """'#' becomes a digit, '@' an upper case letter."""
        return "".join(self.digits(1) if c == "#" else chr(65 + int(self.rng.integers(26))) if c == "@" else c for c in form)

    def word(self, low: int = 2, high: int = 4) -> str:
        return "".join(self.one(HEADS) + self.one(VOWELS) for _ in range(int(self.rng.integers(low, high)))) + (self.one(TAILS) if self.chance(0.6) else "")

    def given(self) -> str:
        return self.one(GIVEN) if self.chance(0.5) else self.word().capitalize()

    def family(self) -> str:
        name = self.one(FAMILY) if self.chance(0.5) else self.word().capitalize()
        if self.chance(0.08):
            name += "-" + (self.one(FAMILY) if self.chance(0.5) else self.word().capitalize())
        return f"{self.one(PARTICLES)} {name}" if self.chance(0.06) else name

    def cased(self, text: str) -> str:
        r = self.rng.random()
        return text.upper() if r < 0.08 else text.lower() if r < 0.16 else text

    def person(self) -> str:
        g, f, i = self.given(), self.family(), chr(65 + int(self.rng.integers(26))) + "."
        r = int(self.rng.integers(12))
        name = [f"{g} {f}", f"{g} {f}", f"{g} {f}", f"{g} {i} {f}", f"{g} {self.given()} {f}", f"{i} {f}", f"{i} {f}", f"{f}, {g}", f"{f}, {i}", f"{f} {g}", f"{g}-{self.given()} {f}", f"{f}, {g} {i}"][r]
        return self.cased(name)

    def titled(self) -> str:
        return self.cased(self.family()) if self.chance(0.75) else self.person()

    def email(self) -> str:
        g, f = (re.sub(r"[^a-z]", "", x.lower()) or "x" for x in (self.given(), self.family()))
        user = self.one([f"{g}.{f}", f"{g[0]}.{f}", f"{g}{f}", f"{g}_{f}", f"{g}{self.digits(4)}", f"{f}", f"{f}+{self.word()}", f"{g}-{f}", f"{g}.{f}{self.digits(2)}"])
        host = (self.one(HOSTS) if self.chance(0.5) else self.word()) + "." + self.one(ENDS)
        if self.chance(0.1):
            host = self.word() + "." + host
        at, dot = self.one([("@", ".")] * 8 + [(" at ", " dot "), (" [at] ", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" @ ", "."), ("(at)", ".")])
        text = user + at + host.replace(".", dot)
        return text.upper() if self.chance(0.05) else text

    def phone(self) -> str:
        form = self.one([
            "+## ## ### ## ##", "+## ### ### ####", "(###) ###-####", "###-###-####", "### ### ####", "###.###.####", "##########", "+1 ### ### ####", "+1-###-###-####", "+1 (###) ###-####",
            "0## ########", "0### ######", "0####/######", "0## ### ## ##", "0# ## ## ## ##", "0#.##.##.##.##", "+33 # ## ## ## ##", "+33 (0)# ## ## ## ##", "+33#########", "0#########", "+49 ### #######", "0049 ## #####-###",
            "+49 (0)## ########", "(0##) ### ####", "07### ######", "07### ### ###", "+44 7### ######", "+447#########", "(0####) ######", "+34 6## ## ## ##", "6## ### ###", "9## ## ## ##", "+34#########", "###-####", "### ####", "1-800-###-####",
            "+## (#) ### ### ###", "00## ### ######", "### ### ### ext. ###", "###-#### ext ##",
        ])
        return self.fill(form)

    def ident(self) -> str:
        return self.fill(self.one([
            "###-##-####", "### ## ####", "#########", "## ### ###", "### ### ####", "########@", "########-@", "@########", "@@#######", "@@######@", "@ ### ### ###", "#######", "######", "@@-####-#####", "#-####-#####-##-#",
            "# ## ## ## ### ### ##", "##########", "###.###.###", "###-###-###", "@#########", "@@@######", "##-######", "@#-####-####", "#### #### ####",
        ]))

    def town(self) -> str:
        t = self.one(TOWNS) if self.chance(0.5) else self.word().capitalize()
        r = self.rng.random()
        return f"Saint-{t}" if r < 0.05 else f"Bad {t}" if r < 0.07 else f"{t}-{self.word().capitalize()}" if r < 0.1 else t

    def address(self) -> str:
        n = str(int(self.rng.integers(1, 420))) + (self.one(["", "", "", "", "a", "B", " b"]))
        zip5, town = self.digits(5), self.town()
        lang = self.one(["en", "en", "fr", "de", "es"])
        if lang == "en":
            base = self.one(STREET_WORDS) if self.chance(0.4) else self.word().capitalize()
            if self.chance(0.2):
                base = self.one(["Old", "New", "North", "Upper", "West"]) + " " + base
            line = f"{n} {base} {self.one(EN_KINDS)}"
            unit = self.one(["Apt", "Apt.", "Unit", "Flat", "Suite", "#"]) + " " + str(int(self.rng.integers(1, 60)))
            r = self.rng.random()
            line = f"{unit}, {line}" if r < 0.12 else f"{line}, {unit}" if r < 0.24 else line
            tail = self.one([f", {town}", f", {town} {zip5}", f", {town}, {self.fill('@@')} {zip5}", f", {town} {self.fill('@@# #@@')}", f", {self.fill('@@## #@@')} {town}", ""])
        elif lang == "fr":
            street = self.one(FR_NAMES) if self.chance(0.6) else "de " + self.word().capitalize()
            line = f"{n}{self.one(['', '', ' bis', ' ter'])}{self.one([' ', ', '])}{self.one(FR_KINDS)} {street}"
            tail = self.one([f", {zip5} {town}", f" {zip5} {town}", f", {town}", ""])
        elif lang == "de":
            stem = self.one(DE_STEMS) if self.chance(0.5) else self.word().capitalize()
            street = self.one(DE_WHOLE) if self.chance(0.25) else self.one([stem + self.one(DE_KINDS), stem + self.one(DE_KINDS), stem + "er " + self.one(["Straße", "Weg", "Platz", "Allee"])])
            line, tail = f"{street} {n}", self.one([f", {zip5} {town}", f" {zip5} {town}", f" in {zip5} {town}", f", {town}", f" in {town}", ""])
        else:
            street = self.one(ES_NAMES) if self.chance(0.6) else "de " + self.word().capitalize()
            line = f"{self.one(ES_KINDS)} {street}{self.one([' ', ', ', ' n.º ', ', nº '])}{n}{self.one(['', '', f', {self.digits(1)}.º {self.fill(chr(64))}'])}"
            tail = self.one([f", {zip5} {town}", f" {zip5} {town}", f", {town}", ""])
        return self.cased(line + tail) if self.chance(0.3) else line + tail

    def slot(self, name: str) -> str:
        r = self.rng
        if name == "drug":
            return (self.word(2, 5) + self.one(["ol", "ine", "mab", "statin", "pril", "ide", "vir"])) if self.chance(0.8) else self.word(2, 5).capitalize()
        if name == "num":
            return self.one([str(int(r.integers(1, 99999))), f"{r.random() * 300:.1f}", self.digits(3), f"{int(r.integers(1, 200))},{self.digits(3)}"])
        if name == "code":
            return self.fill(self.one(["@@#####", "@#######", "###-##-####", "####-###-####", "########", "##########", "@@@-####", "@##.#", "##-#####-##", "#### #### ####", "### ### ###", "@@####@", "+#.##", "#.#.##"]))
        if name == "date":
            y, m, d = int(r.integers(1950, 2026)), int(r.integers(1, 13)), int(r.integers(1, 29))
            return self.one([f"{y}-{m:02}-{d:02}", f"{d}.{m}.{y}", f"{d:02}/{m:02}/{y}", f"{y}{m:02}{d:02}", f"{self.one(['March', 'mai', 'Juni', 'agosto', 'Oct', 'Sept'])} {d}, {y}"])
        if name == "time":
            return f"{int(r.integers(0, 24))}:{int(r.integers(0, 60)):02}"
        if name == "place":
            w = self.word().capitalize() if self.chance(0.7) else self.one(FAMILY)
            return self.one([f"St. {w} Hospital", f"{w} Ward", f"Clinique {w}", f"Klinikum {w}", f"Hospital {w}", f"{w} Unit", f"{w} Medical Centre", f"Station {w}", f"{w} Memorial"])
        if name == "score":
            w = self.word().capitalize() if self.chance(0.6) else self.one(FAMILY)
            v = self.word().capitalize() if self.chance(0.6) else self.one(FAMILY)
            return self.one([f"{w} score", f"{w}–{v} index", f"{w}-{v} scale", f"{w} sign", f"{w} syndrome", f"{w} staging", f"{w} test", f"{w} protocol", f"{w} formula", f"{w}'s disease"])
        return self.word()

    def ramble(self) -> tuple[str, list[tuple[int, int, str]]]:
        """A text of words in random order, with spans anywhere."""
        lang = self.one(list(COMMON))
        text, spans = "", []

        def add(kind: str) -> None:
            nonlocal text
            cue = self.one(CUES[kind])
            got = {"person": self.person, "email": self.email, "phone": self.phone, "id_number": self.ident, "address": self.address}[kind]()
            if kind == "person" and self.chance(0.3):
                cue, got = self.one(CUES["title"]), self.titled()
            elif kind == "person" and got == got.lower() and not cue:
                cue = "my name is"
            elif kind == "phone" and (got[0] in "+(" or got.startswith("00")) and self.chance(0.5):
                cue = ""
            if kind in ("id_number", "phone") and self.chance(0.3) and cue not in ("", "("):
                cue += self.one([":", " is", " #", " no.", " nr."])
            text += cue + ("" if not cue or cue in "(<" else self.one([" ", " ", " ", "  ", "\n"]))
            spans.append((len(text), len(text) + len(got), kind))
            text += got + (")" if cue == "(" else ">" if cue == "<" else "")

        for _ in range(int(self.rng.integers(1, 6))):
            words = int(self.rng.integers(3, 16))
            at = int(self.rng.integers(0, words)) if self.chance(0.65) else -1
            for w in range(words):
                r = self.rng.random()
                if w == at:
                    add(self.one(["person", "person", "person", "email", "phone", "id_number", "address"]))
                elif r < 0.5:
                    word = self.one(COMMON[lang])
                    text += word.capitalize() if w == 0 else word
                elif r < 0.8:
                    word = self.word()
                    text += word.capitalize() if w == 0 or self.chance(0.45 if lang == "de" else 0.08) else word
                elif r < 0.87:
                    text += self.one(CUES["none"]) + self.one([" ", " ", ": ", " #", " no. "]) + (self.slot("code") if self.chance(0.6) else self.slot("num"))
                elif r < 0.92:
                    text += (self.one(FAMILY) if self.chance(0.5) else self.word().capitalize()) + self.one(["", "", "-" + self.word().capitalize()]) + " " + self.one(CUES["thing"])
                else:
                    text += self.slot(self.one(["num", "date", "time", "drug", "place", "score"]))
                text += self.one([" "] * 8 + [", ", ": ", "; ", " "]) if w < words - 1 else self.one([". ", ".\n", "\n", " ", "? ", "! ", ".\n\n", ""])
        return text, spans

    def passage(self) -> tuple[str, list[tuple[int, int, str]]]:
        """A text with its labelled (start, end, kind)."""
        if self.chance(0.6):
            return self.ramble()
        lang = self.one(["en", "en", "fr", "de", "es"])
        text, spans = "", []
        for _ in range(int(self.rng.integers(2, 9))):
            line = self.one(WITH[lang]) if self.chance(0.55) else self.one(WITHOUT[lang])
            for piece in re.split(r"(\{\w+\})", line):
                kind = {"{p}": "person", "{t}": "person", "{e}": "email", "{f}": "phone", "{i}": "id_number", "{a}": "address"}.get(piece)
                if kind is None:
                    text += self.slot(piece[1:-1]) if piece.startswith("{") else piece
                    continue
                got = {"{p}": self.person, "{t}": self.titled, "{e}": self.email, "{f}": self.phone, "{i}": self.ident, "{a}": self.address}[piece]()
                spans.append((len(text), len(text) + len(got), kind))
                text += got
            text += self.one([" ", " ", " ", "\n", "\n", "  ", "\n\n", "\r\n", " - ", "\t"])
        return text, spans


# Sentences: {p} person, {t} surname or name behind a title, {e} email, {f} phone, {i} number of a person, {a} address.
WITH = {
    "en": [
        "Patient {p} was seen on {date}.", "{p} called about the results.", "Please contact {p} at {e}.", "Dr. {t} will review this.", "Mrs {t} reports no pain.", "Seen by Prof. {t} and Dr {t} today.", "Name: {p}", "Patient: {p}, DOB {date}",
        "Phone: {f}", "Tel. {f}", "Call {f} after {time}.", "Mobile {f}, home {f}", "you can text me on {f}", "fax {f}", "Email: {e}", "write to {e} or call {f}", "Forwarded to {e}.", "{p} <{e}>", "cc: {p} <{e}>; {p} <{e}>", "MRN: {i}", "MRN {i}", "SSN {i}",
        "Social security number: {i}", "NHS number {i}", "passport no. {i} checked", "insurance ID {i}", "member number {i} verified", "policy holder {i}", "driving licence {i}", "medical record number {i}", "Chart #{i}", "Address: {a}", "She lives at {a}.", "He moved to {a} last year.",
        "Send the letter to {p}, {a}.", "Ship to: {p}\n{a}", "The patient's mother, {p}, can be reached on {f}.", "Next of kin: {p} ({f})", "my name is {p} and i have questions", "Regards,\n{p}", "Best wishes, {p}", "Signed: {p}", "I spoke with Mr {t} and Ms. {t}.",
        "Interpreter {p} was present.", "Consent obtained from {p}.", "{p} asked whether {drug} can be stopped.", "Referral from Dr {t}, {place}.", "Attn {p}, {a}", "Emergency contact {p}, {f}, {e}", "user {p} logged in from ward", "Mr. {t} has died.", "Account of {p} closed.",
        "reach me under {e}", "The neighbour at {a} found her.", "His ID card number is {i}.", "patient no. {i}", "Caller: {p}. Callback: {f}.", "Hi {p}, thanks for your message.", "Nurse {p} gave {drug} at {time}.",
    ],
    "fr": [
        "Patient : {p}", "La patiente {p} se plaint de fatigue.", "Monsieur {t} prend {drug}.", "Mme {t} a été vue le {date}.", "Dr {t}, {place}", "Le docteur {t} suit ce patient.", "Tél. : {f}", "Joindre au {f}.", "Portable {f}", "Courriel : {e}", "Écrire à {e}",
        "NIR {i}", "N° de sécurité sociale : {i}", "numéro de dossier {i}", "passeport {i} vérifié", "Adresse : {a}", "Il habite {a}.", "Domicilié {a}.", "Compte rendu pour {p}, {a}.", "Cordialement,\n{p}", "Contact : {p}, {f}", "Mlle {t} et M. {t} sont venus.",
        "Nom : {p}", "carte d'assuré {i}", "fille : {p} ({f})", "je m'appelle {p}", "{p} demande un rendez-vous.",
    ],
    "de": [
        "Patient: {p}", "Die Patientin {p} klagt über Schwindel.", "Herr {t} nimmt {drug}.", "Frau {t} kam am {date}.", "Dr. {t} hat angerufen.", "Prof. {t}, {place}", "Tel.: {f}", "Rückruf unter {f}.", "Handy {f}", "E-Mail: {e}", "Bitte an {e} senden.",
        "Versichertennummer {i}", "Patienten-ID: {i}", "Sozialversicherungsnummer {i}", "Reisepass Nr. {i}", "Anschrift: {a}", "Wohnhaft {a}.", "Er wohnt in der {a}.", "Bericht an {p}, {a}.", "Mit freundlichen Grüßen\n{p}", "Ansprechpartner: {p}, {f}",
        "Name: {p}", "Ausweisnummer {i}", "Tochter: {p} ({f})", "mein Name ist {p}", "{p} fragt nach dem Befund.", "Herr {t} und Frau {t} waren da.",
    ],
    "es": [
        "Paciente: {p}", "La paciente {p} refiere mareo.", "El Sr. {t} toma {drug}.", "La Sra. {t} acudió el {date}.", "Dr. {t}, {place}", "La Dra. {t} llamó.", "Teléfono: {f}", "Llamar al {f}.", "Móvil {f}", "Correo: {e}", "Escribir a {e}", "DNI {i}", "NIE {i}",
        "Número de historia {i}", "pasaporte {i} comprobado", "tarjeta sanitaria {i}", "Dirección: {a}", "Vive en {a}.", "Domicilio: {a}.", "Informe para {p}, {a}.", "Un saludo,\n{p}", "Contacto: {p}, {f}", "Nombre: {p}", "hija: {p} ({f})", "me llamo {p}",
        "{p} pregunta por los resultados.", "Don {t} y Doña {t} vinieron.",
    ],
}
WITHOUT = {
    "en": [
        "The {score} was {num}.", "{place} was closed on {date}.", "Order {code} has shipped.", "Lot {code} of {drug} expired.", "Study {code} enrolled {num} persons.", "Concept {code} maps to {drug}.", "BP {num}/{num}, pulse {num}.", "Take {drug} {num} mg twice daily.",
        "Invoice no. {code} paid.", "Batch {code}, serial {code}.", "Transferred to {place} at {time}.", "According to the {score}, the risk is low.", "See table {num} and figure {num}.", "Version {code} was released.", "error {code} in module {w}", "{num} rows written in {num} s",
        "Room {num}, floor {num}.", "Ticket {code} closed.", "{drug} inhibits {w} kinase.", "{drug} is a selective {w} agonist.", "No headache since the last visit.", "Results were {num} on {date}, before {num}.", "The trial {code} met its endpoint (p = {num}).",
        "run {code} finished, checksum {code}", "Part number {code} is out of stock.", "user=batch@job{num} retry", "Doses above {num} mg bring little change.", "ISBN {code}", "tracking {code}", "The {score} and the {score} were not used.", "Coordinates {num}, {num}.",
        "Reference range {num}-{num}.", "Monitoring continued for {num} weeks.", "The committee met at {time}.", "Mixed {drug} with {drug}.", "See also {w} and {w}.", "Nothing to report today.", "path /data/{w}/{code}.parquet merged", "twitter @{w} posted", "Protocol {code} amended {date}.",
    ],
    "fr": [
        "Le score {score} n'a pas été utilisé.", "Commande {code} expédiée.", "Lot {code} délivré le {date}.", "L'étude {code} compte {num} personnes.", "TA {num}/{num}.", "Prendre {drug} {num} mg.", "Transfert vers {place} à {time}.", "Facture {code} réglée.",
        "Pas de nausées depuis la dernière visite.", "Valeur {num} le {date}, avant {num}.", "Chambre {num}, étage {num}.", "{drug} agit sur {w}.", "Voir le tableau {num}.", "Concept {code} : {drug}.", "Version {code} publiée.", "Le protocole {code} est clos.",
    ],
    "de": [
        "Der {score} war {num}.", "Bestellung {code} versandt.", "Charge {code} ausgegeben am {date}.", "Studie {code} umfasst {num} Personen.", "RR {num}/{num}.", "{drug} {num} mg täglich.", "Verlegung nach {place} um {time}.", "Rechnung {code} bezahlt.",
        "Keine Übelkeit seit dem letzten Besuch.", "Wert {num} am {date}, zuvor {num}.", "Zimmer {num}, Etage {num}.", "{drug} hemmt {w}.", "Siehe Tabelle {num}.", "Konzept {code}: {drug}.", "Version {code} freigegeben.", "Umstellung von {drug} auf {drug}.",
    ],
    "es": [
        "No se aplicó {score}.", "Pedido {code} enviado.", "Lote {code} entregado el {date}.", "El estudio {code} tiene {num} personas.", "TA {num}/{num}.", "Tomar {drug} {num} mg.", "Traslado a {place} a las {time}.", "Factura {code} pagada.", "Sin náuseas desde la última visita.",
        "Valor {num} el {date}, antes {num}.", "Habitación {num}, planta {num}.", "{drug} actúa sobre {w}.", "Ver tabla {num}.", "Concepto {code}: {drug}.", "Versión {code} publicada.", "Se cambia {drug} por {drug}.",
    ],
}
