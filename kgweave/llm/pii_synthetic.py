"""Made-up personal information to train the tagger with, beyond what one set of texts holds.

Names are drawn from common given names and surnames of several languages and from random
syllables; addresses, numbers and mail addresses follow the grammars of many countries.  They take the
place of labelled spans in texts, or stand in sentences of their own.  Only training uses this module.
"""

from __future__ import annotations

import numpy as np

# Common names, and words that make up addresses, labels and sentences.
GIVEN = (
    "James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Margaret Mark Sandra "
    "Paul Ashley Steven Emily Andrew Donna Kenneth Michelle Katherine Brian Amanda Kevin Melissa Anna Peter Laura Martin Claudia Stefan Monika Andreas Sabine Jean Marie Pierre Isabelle Luc Camille José Carmen "
    "Antonio Lucía Manuel Elena Javier Pilar Giovanni Francesca Marco Giulia Wei Li Ming Hiroshi Yuki Kenji Priyanka Arjun Ananya Rahul Fatima Ahmed Omar Leila Olga Ivan Natasha Sergei Piotr Agnieszka Lars Ingrid Erik Astrid Chidi Ngozi Kwame Ama"
).split()
SURNAMES = (
    "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Thomas Taylor Moore Jackson Martin Lee Perez Thompson White Harris Sanchez Clark Ramirez Lewis "
    "Robinson Walker Young Allen King Wright Scott Torres Nguyen Hill Flores Green Adams Nelson Baker Hall Rivera Campbell Mitchell Carter Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Dubois Durand Lefebvre "
    "Moreau Laurent Rossi Russo Ferrari Bianchi Romano Zhang Wang Chen Liu Tanaka Suzuki Sato Patel Sharma Singh Kumar Khan Hussain Ali Ivanov Petrov Kowalski Nowak Hansen Olsen Johansson Okafor Mensah Silva Santos Costa"
).split()
WAYS = "Street St. Road Rd Avenue Ave Lane Drive Close Terrace Blvd Boulevard Way Court Place Square Crescent Gardens".split()
STREETS = "Maple Oak Elm High Church Park Mill Victoria Station Cedar Lincoln Jefferson Lake Pine King's Queen's Green Washington Ridge River Spring Chestnut".split()
LABELS = ["SSN", "Social security no.", "NHS number", "NHS no.", "MRN:", "Medical record number", "Passport no.", "Passport", "DNI", "NIE", "Tax ID", "National ID", "Insurance no.", "Hospital no.", "Member ID", "Patient ID:", "Versichertennr.", "N° Sécu", "ID no."]
TITLES = ["Dr.", "Dr", "Prof.", "Mr", "Mr.", "Mrs", "Mrs.", "Ms", "Frau", "Herr", "Mme", "Sr.", "Sra."]
SENTENCES = [
    "Please contact {name} at {phone} or {email}.", "Patient: {name}, {label} {id_number}.", "{name} was seen by {title} {surname} last week.", "Letter to {title} {surname}, {address}.", "Reply to {email} before Friday.",
    "{title} {name} lives at {address} and can be called on {phone}.", "Next of kin: {name} ({phone}).", "Signed, {name}", "Dear {title} {surname}, thank you for referring {name}.", "cc: {name} <{email}>", "Tel. {phone}; e-mail {email}",
    "{label} {id_number}, address {address}.", "Attending physician {name}, phone {phone}.", "We thank {name} and {name} for their help.", "Send results to {address}.", "Reviewed with {title} {surname} and {name}.", "{name}, {address}, {phone}", "Home: {address}. {label} {id_number}.",
]
PLAIN = [
    "The Apgar score was {n} and the Barthel index {n}.", "Kaplan-Meier curves of {n} patients were drawn.", "Hodgkin lymphoma and Crohn disease were excluded.", "Lot {n}-{n}-{n}, catalogue number {n}/{n}.", "NCT0{n}{n} enrolled {n} subjects at site {n} North.",
    "Parkinson disease affected {n} of {n}.", "At {n} Drive units per ml the cohort of {n} responded.", "The Wilcoxon test gave p = 0.0{n}.", "Dose {n} mg, then {n} mg b.i.d. for {n} days.", "See doi:10.{n}/abc.{n}.{n} and assay AB-{n}.", "CAS {n}-{n}-{n} was used; room temperature {n} °C.", "Version {n}.{n}.{n} of the software, run {n} of {n}, on {n}-{n}-{n}.",
]


class Maker:
    """Draws personal information of each kind."""

    def __init__(self, seed: int) -> None:
        self.r = np.random.default_rng(seed)

    def one(self, of):
        return of[int(self.r.integers(len(of)))]

    def digits(self, pattern: str) -> str:
        """# as any digit, @ as any capital."""
        return "".join(str(self.r.integers(10)) if c == "#" else chr(65 + self.r.integers(26)) if c == "@" else c for c in pattern)

    def word(self) -> str:
        on, v, end = ["b", "br", "c", "ch", "d", "dr", "f", "g", "gr", "h", "j", "k", "kr", "l", "m", "n", "p", "r", "s", "sch", "st", "t", "th", "tr", "v", "w", "z", ""], ["a", "e", "i", "o", "u", "ai", "ei", "ou", "y"], ["", "n", "r", "s", "l", "m", "ck", "rt", "nd", "ski", "sen", "son", "ez", "ov", "ini", "berg", "mann", "ton", "ley", "worth", "ard", "ia"]
        return ("".join(self.one(on) + self.one(v) for _ in range(1 + int(self.r.random() < 0.6))) + self.one(end)).capitalize()

    def surname(self) -> str:
        s = self.one(SURNAMES) if self.r.random() < 0.4 else self.word() if self.r.random() < 0.75 else self.word() + self.word().lower()
        k = self.r.random()
        s = "O'" + s if k < 0.05 else self.one(["Mc", "Mac"]) + s if k < 0.1 else f"{s}-{self.surname()}" if k < 0.16 else self.one(["van ", "van der ", "de ", "de la ", "von ", "di ", "Al-", "El "]) + s if k < 0.22 else s
        return s

    def given(self) -> str:
        g = self.one(GIVEN) if self.r.random() < 0.7 else self.word()
        return f"{g}-{self.one(GIVEN)}" if self.r.random() < 0.05 else g

    def name(self) -> str:
        k, g, s = self.r.random(), self.given(), self.surname()
        initial = chr(65 + int(self.r.integers(26)))
        out = f"{g} {s}" if k < 0.55 else f"{g} {initial}. {s}" if k < 0.68 else f"{initial}. {s}" if k < 0.8 else f"{s}, {g}" if k < 0.92 else f"{g} {self.given()} {s}"
        k = self.r.random()
        return out.upper() if k < 0.05 else out.lower() if k < 0.08 else out

    def email(self) -> str:
        a, b = (x.lower().replace(" ", "").replace("'", "") for x in (self.given(), self.surname()))
        user = self.one([f"{a}.{b}", f"{a}_{b}", f"{a[0]}{b}", f"{b}{self.r.integers(100)}", a, f"{a}.{b}+{self.one(['news', 'trial', 'x'])}", f"{b}.{a}"])
        host = self.one(["gmail", "yahoo", "outlook", "hospital", "uni-" + self.word().lower(), "mail." + self.word().lower(), self.word().lower(), "med.lab-" + self.word().lower()])
        tld = self.one(["com", "org", "net", "edu", "de", "fr", "es", "it", "co.uk", "ac.uk", "example", "test", "invalid", "example.org", "eu", "io"])
        k = self.r.random()
        out = f"{user}@{host}.{tld}" if k < 0.85 else f"{user} [at] {host}.{tld}" if k < 0.92 else f"{user}(at){host}[dot]{tld}"
        return out.upper() if self.r.random() < 0.04 else out

    def phone(self) -> str:
        return self.digits(self.one(["+1 ### ### ####", "1-###-###-####", "(###) ###-####", "###-###-####", "###.###.####", "### ### ####", "+1-###-###-####", "+44 #### ### ###", "+44 (0)#### ### ###", "0#### ######", "0#### ### ###", "07### ### ###", "+44 7### ######", "+49 ## #######", "0049 ## ########", "0## #######", "0##/#######", "+33 # ## ## ## ##", "0# ## ## ## ##", "+34 ### ### ###", "### ## ## ##", "+61 # #### ####", "(0#) #### ####", "+39 ## #### ####", "+91 ##### #####", "+81 ##-####-####", "+86 ### #### ####"]))

    def id_number(self) -> str:
        return self.digits(self.one(["###-##-####", "### ### ####", "##########", "########@", "@#######@", "@########", "#######", "######", "##-#######", "### ## ####", "# ## ## ## ### ### ##", "@######", "##/######", "########-@", "###.###.###"]))

    def address(self) -> str:
        n, st = int(self.r.integers(1, 2500)), self.one(STREETS) if self.r.random() < 0.35 else self.word() if self.r.random() < 0.6 else self.surname().split(" ")[-1]
        unit = f", {self.one(['Apt', 'Apt.', 'Flat', 'Unit', 'Suite'])} {self.r.integers(1, 60)}{self.one(['', '', 'B'])}" if self.r.random() < 0.25 else ""
        k = self.r.random()
        num = f"{n}{self.one(['', '', '', 'A', 'b'])}"
        if k < 0.55:
            return f"{num} {self.one(['', '', '', 'North ', 'South ', 'East ', 'West '])}{st} {self.one(WAYS)}{unit}"
        if k < 0.65:
            return f"Flat {self.r.integers(1, 40)}, {num} {st} {self.one(WAYS)}"
        if k < 0.75:
            return f"{st}{self.one(['straße', 'strasse', 'weg', 'gasse', 'allee'])} {num}{unit}"
        if k < 0.87:
            return f"{self.one(['Calle', 'Avenida', 'Via', 'Plaza'])} {st} {num}{unit}"
        return f"{num}{self.one(['', ' bis', ' ter'])}{self.one(['', ','])} {self.one(['rue', 'avenue', 'boulevard', 'place'])} {self.one(['', '', 'de ', 'du ', 'de la '])}{st}{unit}"

    def fill(self, kind: str) -> str:
        return getattr(self, kind)()

    def sentence(self) -> tuple[str, list[tuple[int, int, str]]]:
        """A sentence with spans, or, one in four, one without."""
        if self.r.random() < 0.25:
            return self._numbers(self.one(PLAIN)), []
        out, spans, rest = "", [], self.one(SENTENCES)
        while "{" in rest:
            before, rest = rest.split("{", 1)
            field, rest = rest.split("}", 1)
            out += before
            value = self.one(TITLES) if field == "title" else self.one(LABELS) if field == "label" else self.fill(field)
            if field not in ("title", "label"):
                spans.append((len(out), len(out) + len(value), "name" if field == "surname" else field))
            out += value
        return out + rest, spans

    def _numbers(self, text: str) -> str:
        while "{n}" in text:
            text = text.replace("{n}", str(self.r.integers(1, 10 ** int(self.r.integers(1, 6)))), 1)
        return text

    def replaced(self, text: str, spans: list[tuple[int, int, str]], share: float = 0.8, of: dict[str, list[str]] | None = None) -> tuple[str, list[tuple[int, int, str]]]:
        """The text with a share of its spans replaced, by made-up ones or by others ``of`` their kind, now and then in another case."""
        out, new, at = "", [], 0
        for a, b, kind in spans:
            out += text[at:a]
            alone = kind == "name" and " " not in text[a:b].strip()
            value = text[a:b] if self.r.random() >= share else self.one(of[kind]) if of else self.surname() if alone else self.fill(kind)
            case = self.r.random()
            value = value.upper() if of and case < 0.12 else value.lower() if of and case < 0.24 else value
            new.append((len(out), len(out) + len(value), kind))
            out += value
            at = b
        return out + text[at:], new
