"""The small labelled tables from which the two sequence models are trained.

Each row is a text with its spans. The rows are written here, as annotated sentence forms whose slots are filled from invented values; none comes from a test
table. `rows("pii")` and `rows("secrets")` give the same table each time.
"""

from __future__ import annotations

import base64
import random
import re
import string

Row = tuple[str, list[tuple[int, int, str]]]

GIVEN = "Adela Borys Cleo Dorrit Elvan Fenna Gustl Hanneke Isra Joris Kaveh Lotte Milo Neave Osric Pia Quentin Runa Stellan Thora Umar Vesna Wilfred Xavi Ylva Zahra Åse Émile Jürgen Chloé Ingrid Tomás Siân Opal Clay Forrest Ivy Hazel Rose Ash Cliff Sunny Pearl Holly Daria Emre Faisal Gwen Hiro Ilse Kenji Marisol Jørgen Øystein Žofie Łucja Renée Bjørn Søla".split()
FAMILY = "Abernath Birchmoor Castlereed Dunholt Everlake Foxgrove Glenmarsh Hollowell Ironbridge Jutteborg Kingsmere Lindqvar Marchbanks Norrvik Orchardson Pemberwick Quistgaard Ravensholm Stormvale Thistlewood Ulvestad Vandermoor Westerby Yelverton Zimmerlund O'Farrowby Mac-Dunnell d'Arcelle Bell Woods Field Moss-Hartley Clay-Norring Larch Mbeyani Nakagomi Oyelarin Petrovek Szczebor Takeshida Hallweger-Orm Fenwick-Dahl Brandl-Uhr Corrowin Larrow Bellamont".split()
STREETS = "Alderbrook Bramblewood Cinderford Dovecote Elmhurst Foxglove Greyfriar Hopfield Ivybridge Juniper Kilnbank Lavender Meadowsweet Northgate Oldmill Potter's Ridgeway".split() + ["Old Mint", "Long Acre", "New Weir", "Old Bakery", "Cooper's", "Weaver's", "Mason's", "Fuller's"]
TOWNS = "Ashcombe Brightwater Coldharbour Dunesford Eastmere Fallowfield Graymouth Highcliff Inverloch Nieder-Walde Saint-Aubrin Porto Velden".split() + ["Port Amble", "Mount Cary", "San Ardo"]
NOUNS = "cache parser queue shard ledger worker buffer schema cursor router snapshot digest window token index record header thread socket bucket session payload digest stream lexer mailer planner".split()
VERBS = "flushes splits merges retries scans packs drops caches rotates hashes counts prunes batches rebuilds loads".split()
ADJ = "stale lazy sparse narrow eager cached pending silent partial nested flaky brittle idle shallow".split()
#: Ordinary words that are names as well.
BOTH = "amber jade reed flint heath robin stone page coral basil linden dusk briar alder kestrel wren hazel rose ivy clay ash opal field bell woods larch pearl holly".split()


class Slots:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def pick(self, *xs):
        return self.r.choice(xs)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice(string.digits) for _ in range(n))

    def ident(self) -> str:
        a, b = self.r.choice(VERBS).rstrip("s"), self.r.choice(NOUNS)
        return self.pick(f"{a}_{b}", f"{a}{b.title()}", f"{a}_{b}_{self.pick('v2', 'safe', 'all', 'once', 'lazy')}")

    def path(self) -> str:
        return f"{self.pick('src', 'core', 'api', 'docs', 'tests', 'ui', 'lib')}/{self.r.choice(NOUNS)}/{self.ident()}.{self.pick('py', 'rs', 'ts', 'go', 'md', 'sql', 'toml', 'yaml')}"

    def name(self) -> str:
        g, f = self.r.choice(GIVEN), self.r.choice(FAMILY)
        i = self.r.choice("ABCDEFGHKLMNPRSTVW")
        form = self.r.random()
        if form < 0.42:
            return f"{g} {f}"
        if form < 0.50:
            return f"{g} {f}".lower()
        if form < 0.58:
            return f"{f.upper()}, {g}"
        if form < 0.66:
            return f"{g} {i}."
        if form < 0.72:
            return f"{g} {i}. {f}"
        if form < 0.78:
            return f"{i}. {f}"
        if form < 0.86:
            return f"{f}-san"
        if form < 0.94:
            return f"{self.pick('Mr.', 'Ms', 'Mrs.', 'Dr.', 'Prof.', 'Mr', 'Dr', 'Frau', 'Herr', 'Mme')} {f}"
        if form < 0.97:
            return f"{f}, {g}"
        return f"{g.upper()} {f.upper()}"

    def email(self) -> str:
        g = re.sub(r"\W", "", self.r.choice(GIVEN + BOTH).lower()).encode("ascii", "ignore").decode() or "ada"
        f = re.sub(r"[^a-z\-]", "", self.r.choice(FAMILY).lower())
        local = self.pick(f"{g}.{f}", f"{g}_{self.digits(2)}", f"{g[0]}{f}", f"{f}-{g[0]}", f"{g}+{self.r.choice(NOUNS)}", f, g, f"{g}{self.digits(2)}")
        host = self.pick("example.com", "example.org", "example.net", "mail.example.com", "dev.example.org", "ops.invalid", "birch-labs.example", "stonemoor.test", "post.invalid", "corp.example")
        x, form = f"{local}@{host}", self.r.random()
        if form < 0.50:
            return x
        if form < 0.60:
            return x.replace("@", " [at] ").replace(".", " [dot] ") if "." not in local else local + " [at] " + host.replace(".", " [dot] ")
        if form < 0.70:
            return local + " at " + host.replace(".", " dot ")
        if form < 0.79:
            return x.replace("@", "(at)")
        if form < 0.88:
            return x.replace("@", "%40")
        if form < 0.93:
            return x.upper()
        if form < 0.96:
            return local + " (at) " + host.replace(".", " (dot) ")
        return local + self.pick("＠", "&#64;", "{at}", " @ ") + host

    def phone(self) -> str:
        d = self.digits
        x = self.pick(
            f"(555) 010-0{d(3)}", f"1-202-555-0{d(3)}", f"415.555.0{d(3)}", f"+1 555 010 0{d(3)}", f"+1555010{d(4)}", f"+1555{d(7)}", f"+44 7700 900{d(3)}", f"+44 7700 900{d(3)}".replace(" ", "\u00a0"), f"020 7946 0{d(3)}",
            f"+49 30 23{d(3)} {d(3)}", f"0049 (0)30 23{d(3)}-{d(3)}", f"030/23{d(3)}-{d(3)}", f"+33 1 99 00 {d(2)} {d(2)}", f"01 99 00 {d(2)} {d(2)}", f"555-010-{d(4)}", f"+34 900 {d(3)} {d(3)}", f"+81-3-5555-{d(4)}", f"(0{d(2)}) {d(3)}-{d(4)}",
        )
        return x + (self.pick(" ext. ", " x", " ext ") + d(3) if self.r.random() < 0.12 else "")

    def id_number(self) -> tuple[str, str]:
        """(label that stands before it, number)"""
        d = self.digits
        kind = self.r.randrange(9)
        if kind == 0:
            return self.pick("SSN ", "ssn: ", "social security number ", "SSN: ", "", ""), f"9{d(2)}-{d(2)}-{d(4)}"
        if kind == 1:
            return self.pick("social security number ", "SSN ", "soc. sec. no. "), f"9{d(2)} {d(2)} {d(4)}"
        if kind == 2:
            return self.pick("numéro de sécurité sociale ", "sécurité sociale ", "NIR "), f"{self.pick('1', '2', '9')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}"
        if kind == 3:
            return self.pick("Steuer-ID ", "Steuernummer ", "tax ID ", "Steuer-Identifikationsnummer "), self.pick(f"0{d(10)}", f"0{d(1)} {d(3)} {d(3)} {d(3)}")
        if kind == 4:
            return self.pick("passport no. ", "passport number ", "passport ", "Reisepass Nr. ", "pasaporte ", "passeport n° "), self.pick(f"X{d(7)}", f"{self.r.choice('CFGHK')}{d(8)}", f"XA{d(7)}")
        if kind == 5:
            return self.pick("NI number ", "national insurance number ", "NINO "), self.pick(f"QQ {d(2)} {d(2)} {d(2)} {self.r.choice('ABCD')}", f"QQ{d(6)}{self.r.choice('ABCD')}")
        if kind == 6:
            return self.pick("driving licence ", "driver's license ", "licence no. ", "Führerschein "), self.pick(f"{self.r.choice(['FARRO', 'BIRCH', 'STORM', 'LINDQ'])}{d(6)}T99ZX", f"D{d(7)}", f"B{d(3)}RRE{d(1)}I{d(2)}")
        if kind == 7:
            return self.pick("identity card ", "ID card no. ", "Personalausweis ", "carte d'identité ", "DNI "), self.pick(f"L{d(2)}Z{d(6)}", f"T{d(8)}", f"{d(8)}{self.r.choice('XYZ')}", f"L01X00T{d(2)}")
        return self.pick("tax ID ", "TIN ", "taxpayer number ", "tax number "), self.pick(f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(2)}-{d(7)}", d(11))

    def address(self) -> str:
        s, t, d = self.r.choice(STREETS), self.r.choice(TOWNS), self.digits
        n = str(self.r.randrange(1, 990))
        p = self.pick("ZX", "ZZ") + self.digits(self.pick(1, 2)) + " " + self.digits(1) + "QQ"
        us = f"{self.pick('ZZ', 'NX')} 000{d(2)}"
        sp = f"{n} {s} {self.pick('St.', 'Road', 'Lane', 'Street', 'Ave', 'Close', 'Drive', 'Court', 'Way', 'Rd.', 'Square')}"
        one = [
            f"{sp}, {t}", f"{sp}, {t}, {p}", f"{sp}", f"Flat {d(1)}, {sp}, {t}, {p}", f"Flat {d(1)}\n{n} {s} Road\n{t}\n{p}", f"{n}0 {self.pick('N.', 'S.', 'W.')} {s} Ave, Apt {d(1)}B, {t}, {us}", f"{sp}\n{t}, {us}",
            f"{n} bis, rue des {s}, 000{d(2)} {t}", f"{n}, rue de la {s}, 000{d(2)} {t}", f"{n} avenue du {s}, 000{d(2)} {t}", f"{s.replace(chr(39), '')}straße {n}, 000{d(2)} {t}", f"{s.replace(chr(39), '')}weg {n}, 000{d(2)} {t}", f"{s.replace(chr(39), '')}str. {n}, 000{d(2)} {t}",
            f"Calle {s} {n}, 3.º izq., 000{d(2)} {t}", f"Avenida {s} {n}, 000{d(2)} {t}", f"P.O. Box {n}, {t} {p}", f"PO Box {n}, {t}", f"Post Office Box {n}, {t}, {us}", f"Postfach {n}, 000{d(2)} {t}", f"Apartado de Correos {n}, {t}", f"P. O. Box {n}",
            *[f"{n} {s} {self.pick('close', 'lane', 'road', 'street', 'court', 'drive')}, {t}".lower()] * 3, f"p.o. box {n}, {t} {p}".lower(),
        ]
        return self.r.choice(one)

    # credentials

    def alnum(self, n: int, chars: str = string.ascii_letters + string.digits) -> str:
        return "".join(self.r.choice(chars) for _ in range(n))

    def secret(self) -> str:
        b64 = lambda n: base64.b64encode(self.r.randbytes(n)).decode()
        url = lambda n: base64.urlsafe_b64encode(self.r.randbytes(n)).decode().rstrip("=")
        hexa = string.hexdigits.lower()[:16]
        return self.pick(
            f"zk_live_{self.alnum(28)}", f"sq_test_{self.alnum(24)}", f"qtx-{self.alnum(20)}-{self.alnum(13)}", f"glx-{self.alnum(20)}", f"nbp_{self.alnum(36, hexa)}", f"VLT{self.alnum(17, string.ascii_uppercase + string.digits)}", f"AKX{self.alnum(17, string.ascii_uppercase + string.digits)}",
            self.alnum(40, hexa), self.alnum(32, hexa), b64(32), self.alnum(43) + "=", self.uuid(), f"eyJhbGciOiJIUzI1NiIsImtpZCI6Ij{self.alnum(4)}ifQ.{url(45)}.{url(48)}", self.alnum(38), self.alnum(24),
        )

    def uuid(self) -> str:
        h = "0123456789abcdef"
        return "-".join(self.alnum(n, h) for n in (8, 4, 4, 4, 12))

    def password(self) -> str:
        w = lambda: self.pick("anchor", "birch", "cobalt", "dragon", "ember", "falcon", "ginger", "harbor", "indigo", "jasper", "maple", "copper", "kettle", "violin")
        return self.pick(f"{w()}-{w()}-{self.digits(4)}", f"{w().title()}_{self.digits(5)}", f"{w().title()}{self.digits(3)}!{w()}", f"p{self.alnum(9)}%", f"p{self.alnum(10)}", self.alnum(11), f"{self.alnum(6)}#{self.alnum(5)}$", f"{w()}{self.digits(4)}", f"{w().title()}@{self.digits(4)}!", f"{self.alnum(4)}&{self.alnum(6)}", f"S3cr3t-{w()}")

    def pem(self, label: str, indent: str = "", nl: str = "\n", lines: int | None = None) -> str:
        body = [self.alnum(64, string.ascii_letters + string.digits + "+/") for _ in range(lines or self.r.randrange(2, 9))] + [self.alnum(30) + "=="]
        return nl.join([f"-----BEGIN {label}-----", *(indent + x for x in body), f"{indent}-----END {label}-----"])


_PART = re.compile(r"\{(\w+)\}")


def _fill(form: str, s: Slots, tagged: dict[str, str]) -> Row:
    """Fills the slots of a form. tagged: label by slot name; other slots are plain."""
    out, marks, at = "", [], 0
    for m in _PART.finditer(form):
        out += form[at : m.start()]
        at = m.end()
        name = m[1]
        if name == "idn":
            label, value = s.id_number()
            out += label
        elif name.startswith("pem"):
            value = {
                "pem": lambda: s.pem(s.pick("PRIVATE KEY", "RSA PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY", "ENCRYPTED PRIVATE KEY", "DSA PRIVATE KEY")),
                "pemind": lambda: s.pem(s.pick("PRIVATE KEY", "EC PRIVATE KEY", "ENCRYPTED PRIVATE KEY"), "    "),
                "pemesc": lambda: s.pem(s.pick("PRIVATE KEY", "RSA PRIVATE KEY"), nl="\\n"),
                "pempub": lambda: s.pem(s.pick("CERTIFICATE", "PUBLIC KEY", "RSA PUBLIC KEY", "CERTIFICATE REQUEST")),
                "pemcert": lambda: s.pem(s.pick("CERTIFICATE", "PUBLIC KEY"), "    "),
            }[name]()
        else:
            value = {"noun": lambda: s.r.choice(NOUNS), "verb": lambda: s.r.choice(VERBS), "adj": lambda: s.r.choice(ADJ), "n": lambda: str(s.r.randrange(1, 900)), "ident": s.ident, "path": s.path, "both": lambda: s.r.choice(BOTH), "Both": lambda: s.r.choice(BOTH).title(), "uuid": s.uuid, "hex40": lambda: s.alnum(40, "0123456789abcdef"), "hex7": lambda: s.alnum(7, "0123456789abcdef"), "hex64": lambda: s.alnum(64, "0123456789abcdef"), "b64": lambda: s.alnum(s.r.randrange(60, 200)), "d2": lambda: s.digits(2), "given": lambda: s.r.choice(GIVEN), "family": lambda: s.r.choice(FAMILY), "sk": lambda: s.pick(*SECRET_NAMES), "pk": lambda: s.pick(*PASS_NAMES), "secret2": lambda: s.alnum(20)}.get(name, lambda: getattr(s, name)() if hasattr(s, name) else m[0])()
        if name in tagged:
            marks.append((len(out), len(out) + len(value), tagged[name]))
        out += value
    return out + form[at:], marks


PROSE = [
    "The {noun} {verb} the {adj} {noun} after the restart.", "It took {n} ms before the change and {n} rows after it.", "Please check {ident} so that the {noun} no longer {verb} a {adj} {noun}.", "I think the {adj} {noun} comes from `{path}`, because the sort is not stable.", "Nothing else in {path} depends on the {noun}.",
    "Why does the {noun} drop the {noun} during replay?", "Can you rename the {noun} in `{path}` and leave `{ident}` alone?", "So far {ident} handles {n} of the {n} recorded {noun} cases.", "There are {n} places that still {ident} by hand.", "Der Test für `{ident}` schlägt fehl, obwohl die Sperre zu früh endet.", "Le test de `{ident}` échoue alors que le verrou se libère trop tôt.", "La prueba de `{ident}` falla aunque el orden no es estable.", "変更前は{n}件、変更後は{n}件でした。原因は`{path}`にあると思います。", "{ident}を直して、古い断片を{n}件だけ読むようにしてください。",
    "Done: the {noun} now {verb} each {noun} exactly once.", "- [ ] The {noun} was written for {n} projects and now serves {n}.", "## {noun} {n}", "* I added a guard in {ident} that will skip the {noun}.", "We should merge every {noun} before the {noun} {verb} it.", "The {adj} path is fine; the {noun} only misbehaves in strict mode.", "Both the {noun} and the {noun} are {adj} at that point.", "If you retry the {noun}, the {noun} {verb} it again.", "Danach sollten wir den leeren Datensatz noch einmal prüfen.", "Avant, il y avait {n} lignes, maintenant {n}.",
]
CODE = [
    "```python\ndef {ident}(rows):\n    for item in {ident}():\n        raise KeyError(item)\n    log.debug(\"{noun} %s\", {ident})\n    return {ident}\n```", "```sql\nSELECT {noun}_id, count(*) AS n\nFROM {noun}_log\nWHERE {noun} > {n}\nGROUP BY {noun}_id;\n```", "```bash\nset -eu\npython -m tools.{ident} --limit {n}\nrm -f build/{noun}.tmp\ncat {path} | wc -l\ngit diff --stat {hex7}\nexport RUN_MODE={adj}\n```", "```toml\n[{noun}]\n{noun} = {n}\n{noun} = \"{adj}\"\n{noun} = true\n```", "```yaml\n{noun}:\n  {noun}_mode: auto\n  {noun}_limit: {n}\n  {noun}_path: {path}\n```", "```json\n{\n  \"{noun}\": \"{adj}\",\n  \"{noun}\": {n},\n  \"done\": false\n}\n```",
    "```js\nexport async function {ident}(opts) {\n  const {noun} = await {ident}(opts.{noun});\n  items.push({ id: {n}, kind: '{noun}' });\n}\n```", "12:{d2} WARN {noun} {ident} {n} ms", "| {ident} | {n} | {adj} {noun} |", "git checkout {hex40}", "[{\"id\":{n},\"{noun}\":\"{ident}\",\"n\":{d2}},{\"id\":{n},\"{noun}\":\"{ident}\",\"n\":{n}}]", "    {ident} = {ident}({n})\n    assert len({noun}s) == {n}",
]

PII_FORMS = [
    "cc {email}, thanks", "ValueError: no account for '{email}'", "ValueError: no account for 'mailto:{email}'", "<a href=\"mailto:{email}\">contact</a>", "<a href=\"{email}\">contact</a>", "notify = [\"{email}\"]", "From: {email}", "You can reach the owner at {email} if it fails again.", "The export goes to {email} every night.", "Escríbeme a {email} por favor", "Schreib an {email}, bitte", "WHERE mail = '{email}'", "login fails for user {email} since the upgrade", "login fails for user {email} since the upgrade", "cc {email}, thanks", "Escríbeme a {email} por favor", "2025-03-{d2} WARN mailer bounced ({email})", "2025-03-{d2} WARN mailer bounced (mailto:{email})", "contact: {email}", "To: {email}; {email}", "send the dump to {email}.", "\"mail\": \"{email}\",", "user={email} status=403", "Reply-To: <{email}>",
    "fax {phone} cc {email}, thanks", "Signed-off-by: {name} <{email}>", "Co-authored-by: {name} <{email}>", "applicant;{family2};{given2};{phone};{email}", "id;{n};{name};{phone};{email}", "{\"name\": \"{name}\", \"ssn\": \"{idn}\", \"mail\": \"{email}\", \"plan\": \"{adj}\"}", "INSERT INTO users VALUES ('{name}', '{phone}', '{email}');",
    "The form rejected {phone} as invalid.", "fax {phone}", "tel:{phone}", "sms sent to {phone} in {n} s", "Call {phone} when the nightly run breaks.", "On-call today: {phone}.", "my number is {phone}", "\"contact_phone\": \"{phone}\"", "Rückruf bitte unter {phone}", "mobile {phone}", "phone: {phone}", "Mon numéro est le {phone}", "// tel:{phone}", "phone = '{phone}'",
    "The sample row still holds {idn}.", "please remove my {idn} from the log", "The record was matched by {idn}.", "INSERT failed for applicant ({idn})", "duplicate key: {idn}", "Test user: plan basic, {idn}, active", "\"ssn\": \"{idn}\"", "my {idn} was printed in the trace", "customer verified with {idn}", "# {idn}",
    "I moved to {address} last month, so the profile is wrong.", "The geocoder cannot resolve {address}, why?", "deliver_to = \"{address}\"", "address: {address}", "-- \n{name}\n{address}\n{phone}", "Ship the replacement disk to {address}.", "The invoice still shows {address} instead of the new office.", "Unsere Anschrift ist {address}.", "\"street\": \"{address}\",", "Visit us at {address}!", "Regards,\n{name}\n{address}",
    "@todo({name}) clean up", "TODO({name}): remove", "{name} reported this after the demo.", "# reviewed by {name}", "Merci à {name} pour la relecture.", "- owner: {name}", "owner: {name}", "Assigned to {name} on Tuesday.", "Thanks,\n{name}", "Thanks,\r\n{name}", "Best regards,\n{name}", "Gruß,\n{name}", "According to the notes of {name}, it was always like that.", "As {name} said, we should wait.", "Looping in {name} from the platform team.", "assert user.display == \"{name}\"", "Can you ask {name} whether that is safe?", "author = \"{name}\"", "-- \n{name}", "\"name\": \"{name}\",", "{name} wrote the first version.", "ping {name} before you merge", "I talked to {name} about the {noun}.", "Danke an {name} für den Hinweis.", "full_name: {name}", "approved by {name}",
]
PII_NOT = [
    "Use a {both}-style linter rule and a {both} switch mock.", "The {both} warning and the {both} theme are both fine.", "Use a {both} hash and a {both} list.", "{Both} {n} shows the {adj} result.", "{Both} {n} of the report has no rows.", "the {both} page of the {noun}", "See the {Both} module for the {noun}.", "The {Both} release is next.", "{both} = {n}", "Robin {noun} scheduling in the {noun}",
    "The user field already reads [EMAIL] and phone is ***-***-****.", "mail: <redacted>, ssn: ***-**-****", "contact [NAME] at [PHONE]", "The remote is git@forge.invalid:core/{ident}.git as before.", "git clone git@host.invalid:{both}/{ident}.git", "Pinned `@tools/{ident}@8.{d2}.1` in the lockfile.", "npm i @{both}/{ident}@{n}.0.1", "The path /home/{both}{d2}/cache/{ident} is gone.", "The path /home/{given}/src is gone.", "C:\\Users\\{given}\\{ident}", "ssh {both}@10.1.2.3 uptime", "Request {uuid} timed out.", "Segfault at address 0x{hex7}{hex7} in the reader.", "address 0x{hex7} is not mapped", "{n} rows returned", "exit status {n}: {ident}",
    "Session started in {path}.", "order {n}{n}-{n}{n} failed", "build 2025.03.{d2}-{n}", "version {n}.{d2}.{n}", "ticket #{n}{n} is open", "trace id {hex40}", "checksum {hex64}", "timestamp 17{n}{n}{n}", "port 5432 on 10.1.2.{d2}", "@pytest.mark.{ident}", "@property\n  def {ident}(self):", "batch {n}-{n}-{n}{d2} of {n}", "isbn 978-0-{n}-{n}{d2}-1", "2025-03-{d2}T12:{d2}:44Z INFO {noun}", "coordinates 52.{n}{n}, 13.{n}{n}", "invoice no. {n}{n}{n}", "customer id {n}{n}{n} is unknown", "see section {n}.{d2} on page {n}", "commit {hex7} by the bot", "The ID {n}{n}{n} was reused.", "object id {hex40}", "Road to {n}.0", "the fast lane, the {noun} lane", "Drive {n} is full", "Take the first lane: {n} drive slots, {n} way merge.", "the {n} way merge and the {n} court cases", "{n} road tests, {n} lane changes", "Box {n} is empty", "Way {n}: merge {noun}", "The Court test for {n} cases", "Thanks,\nthe {noun} team", "Cheers,\nteam", "- owner: the {noun} team", "owner: platform", "reviewed by two people", "Assigned to nobody on Tuesday.", "As expected, we should wait.", "author = \"bot\"", "@todo(later) clean up", "@todo(#{n}) clean up", "user field {both}", "data dump: {b64}", "url https://db.internal.example/v1/{noun}", "https://user@host.invalid/{path}",
]

SECRET_NAMES = ["api_key", "API_KEY", "apikey", "APIKEY", "apiKey", "api-key", "api.key", "access_key", "accessKey", "access_token", "accessToken", "ACCESS_TOKEN", "authToken", "auth_token", "AUTH-TOKEN", "refresh_token", "REFRESH_TOKEN", "client_secret", "clientSecret", "secret", "secret_key", "SECRET", "svc_secret", "SVC_SECRET", "signing_secret", "SIGNING_SECRET", "signing-secret", "webhookSecret", "webhooksecret", "WEBHOOK_SECRET", "licence_key", "licence.key", "license_key", "service_token", "X-Token", "encryption_key", "hmac_key", "bot_token", "session_token", "token"]
PASS_NAMES = ["password", "PASSWORD", "passwd", "PASSWD", "pass", "PASS", "pwd", "PWD", "pw", "PW", "passphrase", "PASSPHRASE", "db_pass", "DB_PASS", "db_password", "DB_PWD", "smtp_password", "userPassword", "userpassword", "USERPASSWORD", "VAULTPASSWORD", "ADMIN_PW", "admin_password", "LOADERPASS", "LOADER_PASS", "loginPassword", "root_pwd", "keystorePass"]
SECRET_FORMS = [
    "{sk} = \"{secret}\"", "{sk} = '{secret}'", "{sk}=\"{secret}\"", "export {sk}={secret}", "{sk}: {secret}", "  {sk}: '{secret}'", "  \"{sk}\": \"{secret}\",", "const cfg = { {sk}: `{secret}`, region: 'r{d2}' };", "headers = {\"Authorization\": \"Bearer {secret}\"}", "headers = {\"authorization\": \"bearer {secret}\"}", "headers = {\"Authorization\": \"Token {secret}\"}", "curl -H 'X-Api-Key: {secret}' https://cache.invalid/", "curl -H 'X-Auth-Token: {secret}' https://10.1.2.3/", "curl -H \"Authorization: Bearer {secret}\" https://api.invalid/", "fetch('https://localhost/feed?limit=20&key={secret}');", "fetch('https://cache.invalid/feed?limit=20&access_token={secret}');", "fetch('https://db.internal.example/feed?limit=20&sig={secret}');", "https://host.invalid/v1?api_key={secret}&limit=5", "Log line: auth ok key={secret} ttl=60", "I used this key for the call: {secret} and it returned 403.", "The service only accepts {secret} as access key, nothing else.", "my token is {secret}", "my api key is {secret}, can you test it?", "{sk} = (\"{secret}\"\n        \"{secret2}\")", "os.environ[\"{sk}\"] = \"{secret}\"", "os.environ.setdefault(\"{sk}\", \"{secret}\")", "SET {sk} = '{secret}';", "loader --token {secret} --verbose", "loader --api-key={secret}", "token: {secret}", "ENV {sk} {secret}", "client = Client(\"localhost\", {sk}='{secret}')", "the secret is {secret} by the way", "  {sk}: u{secret}", "\"X-Token\": \"{secret}\",",
    "-- {sk} = {secret}", "# {sk}: {secret}", "{sk} := \"{secret}\"", "{sk} => '{secret}',", "<add key=\"{sk}\" value=\"{secret}\" />",
]
PASS_FORMS = [
    "{pk} = \"{password}\"", "{pk}='{password}'", "{pk}: {password}", "  {pk}: {password}\n  pool: 4", "  \"{pk}\": \"{password}\",", "os.environ.setdefault(\"{pk}\", \"{password}\")", "loader login --user svc --pass {password}", "loader login --user svc --password={password}", "loader login --user svc --password {password}", "BROKER = \"proto://svc:{password}@10.1.2.3:5432/{noun}\"", "url = \"proto://svc:{password}@db.internal.example:5432/{noun}\"", "DSN = \"sqldb://svc:{password}@localhost:5432/{noun}\"", "url = \"queue+tls://svc:{password}@cache.invalid:5432/{noun}\"", "postgres://admin:{password}@db.invalid/{noun}", "{pk}='{password}' loader --host db.internal.example", "credentials = { user = \"svc\", {pk} = \"{password}\" }", "The staging password is {password} by the way, please rotate it.", "CREATE USER loader IDENTIFIED BY '{password}';", "ALTER ROLE loader WITH PASSWORD '{password}';", "curl -u deploy:{password} https://10.1.2.3/v1/{noun}", "curl --user deploy:{password} https://db.internal.example/v1/{noun}", "client = connect(\"localhost\", user=\"svc\", {pk}='{password}')", "login svc / {password} still works on db.internal.example", "Use {password} as the passphrase when it asks", "loader login --user svc -p {password}", "Das Passwort ist {password}, bitte ändern.", "le mot de passe est {password}", "la contraseña es {password}", "export {pk}={password}", "log in as admin / {password}", "login: svc:{password}", "my passphrase is {password}", "{pk} := \"{password}\"", "sshpass -p {password} ssh svc@10.1.2.3", "mysql -u root -p{password} {noun}",
]
PEM_FORMS = ["{pem}", "svc_secret = \"\"\"{pem}\n\"\"\"", "{sk} = \"\"\"{pem}\n\"\"\"", "  key_pem: |\n    {pemind}\n  {noun}_limit: auto", "  tls_key: |\n    {pemind}", "cat > key.pem <<X\n{pem}\nX\nexport RUN_MODE=lazy", "  \"private_key\": \"{pemesc}\\n\",\n  \"{noun}\": null,", "Here is the key I use:\n{pem}"]
SECRET_NOT = [
    "{sk} = \"YOUR_API_KEY\"", "{pk} = \"changeme\"", "export {sk}=<your-token-here>", "curl -H \"Authorization: Bearer $TOKEN\" https://api.invalid/", "curl -H \"Authorization: Bearer ${ACCESS_TOKEN}\" https://api.invalid/", "{pk} = os.environ[\"DB_PASS\"]", "{sk} = os.environ[\"{sk}\"]", "{sk} = os.getenv(\"{sk}\")", "const cfg = { {sk}: process.env.{sk}, region: 'r{d2}' };", "  {pk}: ********", "  \"{pk}\": \"********\",", "{pk}: ${DB_PASS}", "  {sk}: ${{ secrets.{sk} }}", "  {pk}: {{ vault_password }}", "{sk} = config.get(\"{sk}\")", "{pk} = getpass.getpass()", "  {pk}: null", "  \"{sk}\": null,", "{pk} = input(\"password: \")", "EXPECTED_SHA256 = \"{hex64}\"", "\"etag\": \"{hex32}\",", "  image: {noun}@sha256:{hex64}", "\"integrity\": \"sha512-{b64}==\",", "request_id = \"{uuid}\"", "Request {uuid} timed out.", "Request {uuid} timed out.", "# Request {uuid} timed out.", "Request {uuid} timed out.", "Session {uuid} was closed.", "{ident} {uuid} failed.", "pixel = \"data:image/png;base64,{b64}\"", "data dump: {b64}", "git checkout {hex40}", "commit {hex40}", "checksum: {hex64}", "ssh-ed25519 AAAAC3NzaC1lZDI1NTE5AAAA{b64} ops@host", "{pempub}", "cert = \"\"\"{pempub}\n\"\"\"", "  signer: |\n    {pemcert}\n  {noun}_limit: {n}", "The key is built from the stem instead of the session id.", "tokens = tokenizer.encode({ident})  # token count {n}", "The {noun} token is split by the {noun}.", "def {ident}(token, key):\n    return key", "primary_key = \"{noun}_id\"", "  sort_key: {noun}_id", "  cache_key: {ident}", "token = next({noun})", "key = row[\"{noun}\"]", "password reset failed for the {noun}", "Please rotate the password of the {noun}.", "the private key is read from disk", "Build 2025.{n}.{d2}-{n}{n} is green.", "max_tokens = {n}", "  \"token_count\": {n},", "if not password:\n    raise ValueError(\"password missing\")", "passwordField.setText(\"\")", "  public_key: {hex64}", "DSN = \"sqldb://localhost:5432/{noun}\"", "url = \"proto://svc@localhost:5432/{noun}\"", "proto://svc:${PW}@localhost:5432/{noun}", "proto://svc:<password>@localhost:5432/{noun}", "password = args.password", "pass", "        pass", "bypass the {noun}", "  pass: true", "secret sauce of the {noun}", "Authorization: Bearer <token>", "-----BEGIN PRIVATE KEY-----\n...\n-----END PRIVATE KEY-----", "md5 {hex32}", "id: {uuid}", "trace_id={hex32} span={hex7}", "The monkey test passes.", "keys = sorted({noun})", "-u {noun}:{noun}", "ratio 3:{n}", "{noun}: {uuid}", "\"id\": \"{uuid}\",", "nonce_len = {n}", "{sk} = \"\"", "{pk} = ''", "{sk}: str", "{pk}: Optional[str] = None", "  {sk}: REDACTED", "  {pk}: <redacted>", "{sk} = load_secret(\"{noun}\")", "`{ident}` returns the token although the key never resets.", "The diff touches {path}, {path} and one {adj} test.", "--password-file {path}", "export {sk}=$({ident})", "export {pk}=$DB_PASS", "{sk} = \"xxxxxxxxxxxxxxxx\"", "  \"{pk}\": \"{{DB_PASSWORD}}\",", "LOG: password authentication failed for user \"svc\"",
]

PII_LABELS = ["O", "email", "phone", "id_number", "street_address", "person_name"]
SECRET_LABELS = ["O", "private_key", "password", "key_or_token"]


def _plain(s: Slots) -> str:
    form = s.pick(*PROSE) if s.r.random() < 0.6 else s.pick(*CODE)
    return _fill(form, s, {})[0]


def rows(which: str, n: int = 8000, seed: int = 20) -> list[Row]:
    """n labelled texts: a third of the slots positive forms, the rest hard negatives and plain prose or code, one to four forms a text."""
    s = Slots(seed + (which == "secrets"))
    s.family2 = lambda: s.r.choice(FAMILY)
    s.given2 = lambda: s.r.choice(GIVEN)
    s.hex32 = lambda: s.alnum(32, "0123456789abcdef")
    pii = which == "pii"
    tagged = {"email": "email", "phone": "phone", "idn": "id_number", "address": "street_address", "name": "person_name", "family2": "person_name", "given2": "person_name"} if pii else {"secret": "key_or_token", "secret2": "key_or_token", "password": "password", "pem": "private_key", "pemind": "private_key", "pemesc": "private_key"}
    yes = PII_FORMS if pii else SECRET_FORMS + PASS_FORMS + PEM_FORMS * 3
    # what the other table marks is a hard negative here
    no = PII_NOT * 3 + SECRET_FORMS + PASS_FORMS + SECRET_NOT if pii else SECRET_NOT * 2 + PII_FORMS + PII_NOT * 2
    out = []
    for k in range(n):
        text, marks = "", []
        for j in range(s.pick(1, 1, 2, 2, 3, 4)):
            x = s.r.random()
            t, m = _fill(yes[(k + j) % len(yes)] if x < 0.42 else s.pick(*yes), s, tagged) if x < 0.5 else _fill(s.pick(*no), s, {}) if x < 0.75 else (_plain(s), [])
            if x < 0.5 and s.r.random() < 0.12:
                mark = s.pick("# ", "// ", "-- ", "- ", "* ")
                t, m = mark + t, [(a + len(mark), b + len(mark), l) for a, b, l in m]
            glue = s.pick(" ", "\n", "\n\n", "\n", " ", ", ") if text else ""
            if "\n" in t or t.startswith(("```", "##", "- ", "* ", "|")):
                glue = glue.replace(" ", "\n").replace(",", "") or ("\n" if text else "")
            marks += [(a + len(text) + len(glue), b + len(text) + len(glue), l) for a, b, l in m]
            text += glue + t
        out.append((text, marks))
    return out
