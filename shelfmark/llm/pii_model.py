"""Semi-Markov conditional random field over candidate segments: training and decoding.

A labelling of a text is a set of non-overlapping segments with kinds; what no segment covers is outside.  The score of
a labelling is the sum over its segments of the weights of their whole-span features.  Segments are bounded in length by
how candidates are made, so the partition sum and the best labelling are found by dynamic programming over the
candidates' bounds, which chooses bounds and kinds jointly.

The weights are fitted here, by stochastic gradient on the conditional likelihood of sentences made from the templates below
(letters of offices, clinics, schools, landlords and the like, thought up for this purpose) with invented names and numbers.
The number of sentences is ``SENTENCES``, a bounded documented sample; fitting takes a few seconds, is seeded, and gives the
same weights everywhere.  Accuracy is measured on sentences of other wording and with other names (``tests/llm``).
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Mapping, Sequence
from functools import lru_cache

from shelfmark.llm import lexicon, pii_words
from shelfmark.llm.pii_segments import Segment, candidates

#: Sentences the weights are fitted on, and passes over them.
SENTENCES, EPOCHS, SEED = 20_000, 4, 11

# Templates, a line each: {E} email, {P} phone, {PB} phone in other letters or solid, {I*} identity number, {A*} address, {N} name of a
# person, {U} such a name where only the words around it tell, {NR} Russian, {NC} Han, {NK} Japanese; {W} other capitalised word, {D} or {d} a common word,
# {Q} a proper noun, # a digit.
TEMPLATES = """
The nurse rang {N} on {P} about the blood test.
Patient: {U}, national insurance number {IN}, phone {P}.
Our landlord {U} can be reached under {P} or by e-mail to {E}.
Dear {U},\\nthank you for your letter.
Kind regards\\n{U}\\n{A}\\n{P}
Yours sincerely,\\n{U}
Attn: {U}, {A}.
Applicant | {U} | {IS} | {P} | {E} |
Name: {U}; tel. {P}; mail: {E}
| {U} | {P} | {E} |
| {N} | {IS} | {E} |
{D} | {U} | {D} | {P} |
| {U} | {D} | {d} |
The driver, {U}, gave {A} as home address.
{N} moved to {A} last spring.
Invite {N}, {N} and {N} to the hearing.
Minutes taken by {N}. Present: {N}, {N}, {N}.
The claimant {U} and the witness {U} were heard on Monday.
A parcel for {U} was left with the neighbour.
Her sister {U} signed for it.
She told {U} that the room was taken.
{U} said that the bill was paid.
{U} wrote a note and left.
Ask Mr ~{S} or Mrs ~{S} for the key.
Dr. ~{U} will see the patient at noon.
Prof. ~{S} was asked to join.
Mail your CV to {E}.
You may reach us at {E} at any time.
Replies to {E} or {E} only.
My address is {A} and my number {P}.
We live at {A}, so ring {P} first.
Ship everything to {A}.
Return undelivered items to {A}.
Text {P} when you arrive.
Fax: {P}
Mobile {P}, office {P}.
In an emergency dial {P}.
Social security number {IS} is on file for {N}.
SSN: {IS}
Her passport, no. {IL}, expires soon.
Passport number {IL} was issued to {N}.
Tax ID {IS} belongs to {N}.
NI number {IN} and passport {IL} were copied.
The tutor {N} ({E}) marks the papers.
The caretaker {N} ({E}, {P}) has a spare key.
Spare keys: {U} ({P}), {N} ({E}).
Dr. ~{S}, {N} and {N} attended.
Ms ~{S}, {N}, {N} and {N} were present.
Signed, Dr. ~{S} The alarm was tested twice.
Seen by Mr ~{S} Before noon the gate was shut.
Paid for by {U}.
This seat is taken for {U}.
Sent from {U} to {U}.
I met {U} and {U} at the counter.
{N}\n{A}
Ask {U} for the receipt.
The pianist {U} was praised.
The new chairman, {U}, has moved.
Der Bäcker {U} hat heute zu.
His SSN is {IS}.
SSN {IS} was typed twice.
Her phone number is {P}.
We owe this to {U}.
Later {U} was seen in the yard.
The old lock was changed by {U} in May.
Письмо отправил {NR}.
The plumber {U} came late.
Would {U} kindly move the car?
Perhaps {U} knows more.
Yesterday {U} fell ill.
Please give {U} the parcel.
Tell {U} about it, and {U} too.
When {U} arrives, ring the bell.
Greetings\n{U}\n{A}
Cheers,\n{U}\n{P}
All the best\n{U}
Der Hausmeister {U} hilft gern.
Die Kollegin {U} kommt morgen.
Gestern war {U} hier.
Die Nummer {P} gehört {U}.
La concierge {U} garde les clés.
Hier {U} a perdu son sac.
El cartero {U} trajo una carta.
Ayer {U} perdió su bolso.
O carteiro {U} trouxe uma carta.
A professora {U} chegou cedo.
Sąsiadka {U} wyjechała wczoraj.
Вчера {NR} потерял ключи.
Врач {NR} болен.
通知{NC}，电话 {PB}。
Workshop: {A} (rear gate).
Pickup point: {A} (knock twice).
Left luggage: {A} ({P}).
Old place: {A}; new place: {A}.
{N}\n{E}
{N}\n{A}\n{E}\n{P}
{N}\n{P}
The singer {U} is ill, so {U} sang.
The goalkeeper {U} was sent off.
Their gardener, {U}, works on Fridays.
We waited for {U}.
Flowers for {U} arrived.
Everybody knows {U}.
The key is held by {U} and {U}.
Seats: {U}, {U}, {U}.
On the phone: {U}, {N}, {U}.
Le boulanger {U} est parti.
Le plombier, {U}, travaille tard.
El pintor {U} fue visto ayer.
O padeiro {U} foi embora.
Kierowca {U} był chory.
Der Maler {U}, {AD}, ist krank.
Wir warten auf {U}.
Вчера приходил {NR}, сегодня нет.
{N} <{E}> wrote:
Prepared by {N}, checked by {N}.
Signed: {U}
Signed by {U} on Monday.
(signed) {N} The door was locked.
Reported by {N} While the pump ran, nothing happened.
Contact person: {U}.
According to {U}, the fence was open.
Frau ~{S} wohnt seit Mai in {AD}.
Der Mieter {U} ist unter {P} zu erreichen.
Sehr geehrter Herr ~{U},
Bitte rufen Sie {N} unter {P} an.
Kundin: {U}, Steuernummer {ID}, {AD}.
Schicken Sie alles an {AD} oder per Mail an {E}.
Mit freundlichen Grüßen\\n{U}
Personalausweis {IL}, ausgestellt für {N}.
Die Zeugin {U} sagte nichts.
Zuständig ist {N}, Durchwahl {P}.
Im Namen von {N} und {N} danken wir.
La patiente {U} habite {AF}.
Madame ~{S} demeurant {AF}.
Appelez le {P} ou écrivez à {E}.
Cher {U}, merci pour tout.
Le locataire {N} (n° de sécurité sociale {IF}) a signé.
Tél. : {P}
Rendez-vous avec {N} au {AF}.
El inquilino {U} vive en {AE}.
La paciente {N}, DNI {IE}, llamó al {P}.
Estimada {U}:
Correo: {E}, móvil {P}.
Envíe el paquete a {AE}.
Firmado: {U}
O utente {U}, CPF {IP}, mora na {AE}.
Prezado {N}, ligue para {P}.
Contribuinte {IP}, morada: {AE}.
Assinado por {N}, e-mail {E}.
Pacjent {U}, PESEL {IZ}, adres: {AP}.
Zadzwoń pod numer {P} lub napisz na {E}.
Pan ~{S} mieszka przy {AP}.
Szanowna Pani {N},
Najemca {N}, dowód osobisty {IL}.
Пациент {NR}, СНИЛС {IG}, тел. {P}.
Паспорт {IR} выдан на имя {NR}.
Уважаемый {NR}, пишите на {E}.
Заявитель {NR} проживает по адресу {AR}.
Адрес: {AR}. Телефон: {P}.
Подписал {NR}.
患者姓名：{NC}，手机 {PB}。
请致电{PB}或发送邮件到 {E}。
{NC}先生住在{AC}。
身份证：{IC}，姓名：{NC}。
经办人 {N}，邮箱 {E}。
收件人 {N}，地址：{AC}。
氏名：{NK}　電話：{PJ}
{NK}さんの住所は{AJ}です。
お問い合わせは {E} または {PJ} まで。
マイナンバー {IJ}（{NK}様）。
責任者 {N}、内線 {PJ}。
住所: {AJ}
""".strip()
TRAPS = """
Invoice 20##-###### was paid; flight {W} #### left at ##:##.
Article number ###.###.###-## replaces item ###-##-####.
ISBN ###-#-##-######-#, pages ###-###, price ##.## EUR.
Version #.##.###.#, build ########, host 10.##.###.##.
Case no. ###-##-#### was closed after ### ### ### seconds.
IBAN ending ####, account #########, card ending ####.
Batch ########### and lot #### #### #### were sold.
Measured at ##.#####, ##.#####; depth #### m, ### samples.
Licence no. ##-###-### covers ### ### ### units.
Order ###-###-#### of ## items; tracking 1##########.
Call number ###.### in room ###-####.
On 20##-##-## about ###-#### cases were counted.
Phone system model ###-#### needs version 0###.
The ID field holds ## digits, the phone field ##.
Fig. ##: {W} Street map, scale 1:#####.
Section ## Road surfaces, pp. ##-###.
Table # Court fees in {W}, ####.
The {W} equation and the {W}-{W} theorem hold.
We use the {W} filter with {W} coefficients.
{W} University and the {W} Institute met at {W} Lake.
Published by {W} & Sons, {W}, ####.
{W} {W} Ltd and {W} Bank signed a contract.
The river {W} flows through {W} Valley near {W}.
A visit to {W}, {W} and {W} is planned.
In {W} {W} the port was closed.
Old {W} Bridge was repaired by {W} Construction.
{G} Street runs to St {G} Hospital and {G} Bay.
The {G} Foundation and the {G} River Trust agreed.
The {G} test, also known as the {G} criterion, failed.
Ministry of {W}, Department of {W} Affairs.
Annual Report of the {W} Council.
Basics of {W} Systems and {W} Design
Manual of {W} {W} Measurement, second edition.
Chapter # Safe Handling of Heavy Loads
\n{D} {D}\n
\n{D} {D}\n{D} {d} {d}
\n#. {D} {D}\n
\n#. {D} {D} {D}\n
\n#. {D} {d} {d} {D} {D}\n
\n{D} {D} {D}\n
\n{W} {W}\n
\n#. {W} {W}\n{W} {d} {w}.
\n#. {D} {d} {D} {W}\n{D} {d} {w}.
\n#. {D} {d} {W}\n{D} {d} {w}.
\n{D} to {D} {D}\n{D} {d} {D}.
\n{W} {D}\n
\n#. {D} {W}\n
\n{D} {D}-{D}\n
\n{D} {d} {D}\n
\n{D} {D} {Q}\n
\n#. {D} {D} ## {d}: {D} {D}\n
\n{D} and {D}: {D} {D} {D}\n
\n#. {D} {d} the {D} {D}\n{D} {d} {d}.
\n{D} {d} {D} {D}\n{D}: {d} {d}.
Remarks about the {D} {D}
The {D} {D} was tested in {Q} {D}.
The new {D} {D} method needs {d} {d}.
Every {D} {D} is {d}.
Each {D} {D} was {d} before the {W} {D} test.
Der {D} {D} ist {d}, das {D} {D} auch.
\n{D} {d}: {D} {D}, {D} {D}, {D} {D}\n
\n{D} der {D}\n
\n{D} de {D}\n
\n{D} de {D} {D} {d}
{D} {d}. {D} {d} {d}.
{D} {d} {d} {Q} {d} {d}, {d} {Q}.
{Q} {D} and {Q} {D} are {d}.
{Q} and {Q}, {Q} or {Q}: {d} {d}.
{D} {d} in {Q}, {Q} {D}.
{W} #### ###### was stored at ##:##.
{W} 0### ###### was dropped.
{W} 0#### ###### was dropped at ##:##.
Value 0### ###### at ##:## is wrong.
Count 0## ##### of ## runs.
{W} ### ### ###, {w} ### ## ####.
{W} {w} ## ### ### ### {w}.
{W} ######### {w}, ########### {w}.
{W}, {W}, {W} and {W} {W} are wet.
{D}, {D}. {D}; {D}, {D} {w}.
{W}, {W}. {W}; {W}, {W} {w}.
{D} {D} number ###-##.
Frequently Asked Questions About Water
Terms And Conditions Of Hire
Monday Tuesday Wednesday meetings start in January or March.
New Guidelines For Public Buildings were issued by Central Office.
Write name@HOST in field # and use @{w} to mark it.
Set the mask to x@# or user@ as described.
The price @ ## EUR includes ##%.
Das {W} Verfahren wurde im {W} Institut in {W} geprüft.
Die Gesellschaft {W} und {W} GmbH, {W}.
Rechnung Nr. ###-###-#### vom ##.##.20##, Seite ###.
Die Neue Ordnung Für Gemeinden gilt ab 20##.
Der Rhein Main Verein traf sich im Alten Rathaus.
La méthode de {W} et la Société {W} de {W}.
Commande ## ## ## ## ## ## annulée; lot ###.###.
Le Musée {W} et la rivière {W} sont fermés.
El Museo {W} y el río {W} están cerrados.
Factura ###-###-###, página ##.
La ley de {W} y la Universidad de {W}.
A Escola {W} e o Rio {W} ficam em {W}.
Encomenda ###.###.### com ## artigos.
Muzeum {W} i Instytut {W} są w {W}.
Zamówienie ### ### ###, strona ##.
Завод {WR} и Институт {WR} закрыты.
Заказ ###-###-##-##, страница ##.
Город {WR} стоит на реке {WR}.
订单号 ###########，版本 #.#.#，共 ### 页。
王府井大街和中山公园在北京。
図##と表##は ####-#### 年の値である。
東京大学と大阪工場で測定した。
注文番号 ###-####-####、ページ ##。
高压泵和黄河水位均正常。
""".strip()


class _Maker:
    """Invented values of each kind."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.given = sorted({x.title() for x in pii_words.GIVEN_NAMES})
        self.common, self.proper = (sorted(x for x in words if len(x) > 4) for words in lexicon.words())

    def pick(self, *x: str) -> str:
        return self.r.choice(x)

    def digits(self, mask: str) -> str:
        return "".join(str(self.r.randrange(10)) if c == "#" else c for c in mask)

    def word(self) -> str:
        return "".join(self.pick(*"bcdfghjklmnprstvwyz") + self.pick(*"aeiouaeiouáéöø") + self.pick("", "", "l", "n", "r", "s") for _ in range(self.r.randrange(1, 4))).title() + self.pick("", "n", "d", "th", "k", "m")

    def surname(self) -> str:
        if self.r.random() < 0.15:
            return self.pick(*self.common).title()  # Baker, Jung, Flores
        one = self.word() + self.pick("", "", "", "son", "berg", "ley", "er", "ez", "ski", "man", "ova", "ini")
        return one + "-" + self.word() if self.r.random() < 0.06 else one

    def name(self, given: str | None = None) -> tuple[str, str]:
        g, s, i = given or self.pick(*self.given), self.surname(), self.pick(*"ABCDEFGHIJKLMNOPRSTVW") + "."
        out = self.pick(f"{g} {s}", f"{g} {s}", f"{g} {s}", f"{g} {s}", f"{g} {i} {s}", f"{i} {s}", f"{i} {i} {s}", f"{s}, {g}", f"{s}, {i}", f"{g.upper()} {s.upper()}", f"{g} {self.word()} {s}", f"{g} {self.word()} {self.pick(*self.given)}", f"{g} {self.pick('de', 'van', 'de la', 'von', 'bin', 'da')} {s}", f"{g}\n{s}")
        return self.pick("", "", "", "", "Ms ", "Mr ", "Dr. ", "Prof. "), out

    def untold(self) -> tuple[str, str]:
        """A name whose given name is in no list, half of the time."""
        at = self.r.random()
        return self.name(self.word() if at < 0.4 else self.pick(*self.proper) if at < 0.7 else None)

    def russian(self) -> tuple[str, str]:
        s = self.pick("Лебед", "Гусар", "Мороз", "Карп", "Сокол", "Верш", "Дубр", "Тал") + self.pick("ов", "ин", "ова", "енко", "ский", "ик")
        i = self.pick(*"АБВГДЕКМНОПРСТ") + "."
        g = self.pick(*sorted(pii_words.GIVEN_CYRILLIC)).title()
        return "", self.pick(f"{g} {s}", f"{s} {g}", f"{s} {i} {self.pick(*'АВМНПС')}.", f"{s} {i}", f"{i} {s}")

    def email(self) -> tuple[str, str]:
        user = self.pick("office.", "", "", self.pick(*self.given).lower() + self.pick(".", "-", "_", "+")) + self.word().lower() + self.pick("", "", "7", "_12")
        host = self.pick("post.", "", "", "web.") + self.word().lower() + self.pick(".com", ".net", ".de", "-4.org", ".co.uk", ".example", ".edu.pl")
        got = self.pick(f"{user}@{host}", f"{user}@{host}", f"{user}@{host}", f"{user} [at] {host}", f"{user}(at){host}", f"{user} (at) {host.replace('.', ' dot ')}", f"{user} at {host.replace('.', ' dot ')}", f"{user}@{host}".upper(), f"{user}@\n{host}")
        return self.pick("", "", "", "<"), got

    def phone(self) -> tuple[str, str]:
        masks = ("+1 ### ### ####", "(###) ###-####", "(###) ###-####", "###-###-####", "###-###-####", "###-###-#### ext. ###", "###.###.####", "555-####", "001-###-###-####", "0## #### ####", "0#### ######", "+44 #### ######", "+###########", "+### ### ### ###", "###-###-###", "### ### ###", "(0##) ### ## ##", "0#.##.##.##.##", "0# ## ## ## ##", "+49##########", "(0##) ##### ###", "0## #####-###", "+33 # ## ## ## ##", "+49 ## ##### ###", "0###/######", "8 (###) ###-##-##", "+7 ### ###-##-##", "9## ## ## ##")
        return "", self.digits(self.pick(*masks))

    def street(self, kind: str) -> tuple[str, str]:
        w, c, n, z = self.word(), self.word(), str(self.r.randrange(1, 300)), self.digits("#####")
        return "", {
            "A": lambda: self.pick("", "", f"Flat {self.r.randrange(1, 9)}, ", f"Apt {n}, ") + n + self.pick("", "", "B") + f" {w} " + self.pick("", "", self.word() + " ") + self.pick("Street", "Road", "Lane", "Row", "Court", "Ave", "St.", "Crescent", "Drive") + self.pick(f", {c}", f", {c}", f", {c} {z}", f", {c} {self.word()}"),
            "AD": lambda: w + self.pick("straße ", "weg ", "platz ", "allee ") + n + self.pick("", "a") + self.pick(f", {z} {c}", f", {c}"),
            "AF": lambda: n + self.pick(" bis ", ", ", " ") + self.pick("rue ", "avenue ", "boulevard ", "place ") + self.pick("", "", "de ", "du ", "des ") + w + self.pick(f", {z} {c}", f", {c}"),
            "AE": lambda: self.pick("Calle ", "Av. ", "Rua ", "Avda. ", "Paseo ") + self.pick("", "", "de ", "da ") + w + self.pick(" ", ", ") + n + f", {c}",
            "AP": lambda: self.pick("ul. ", "al. ", "os. ") + w + f" {n}, {c}",
            "AR": lambda: self.pick("ул. ", "пр. ", "пер. ") + self.pick("Садовая", "Лесная", "Морская", "Заречная") + f", д. {n}",
            "AC": lambda: self.pick("长安路", "人民大道", "和平街", "新华路") + f"{n}号" + self.pick("", "3单元", "502室"),
            "AJ": lambda: self.pick("東京都港区芝", "大阪府吹田市山手町", "千葉県柏市若葉町", "北海道函館市本町") + self.digits("#-#-##").replace("0", "1"),
        }[kind]()

    def number(self, kind: str) -> tuple[str, str]:
        masks = {"IL": ("AB #######", "ZK#######", "QX######", "C#######"), "IS": ("###-##-####", "### ## ####", "#########"), "IN": ("QQ ## ## ## C", "AB######D"), "ID": ("## ### ### ###", "###########"), "IF": ("1 ## ## ## ### ### ##", "2 ## ## ## ### ### ##", "1############"), "IE": ("########K", "########-B", "X-#######-L"), "IP": ("###.###.###-##", "###########"), "IZ": ("###########",), "IG": ("###-###-### ##", "###########"), "IR": ("## ## ######", "#### ######", "#### № ######"), "IC": ("##################", "#################X"), "IJ": ("############", "#### #### ####")}
        return "", self.digits(self.pick(*masks[kind]))

    def value(self, slot: str) -> tuple[str, str, str]:
        if slot in ("W", "w"):
            return "", self.word() if slot == "W" else self.word().lower(), ""
        if slot in ("D", "d"):
            word = self.pick(*self.common)
            return "", word.title() if slot == "D" else word, ""
        if slot == "Q":
            return "", self.pick(*self.proper), ""
        if slot == "WR":
            return "", self.pick("Заречье", "Полянск", "Вельск", "Торма", "Кедров"), ""
        if slot == "G":
            return "", self.pick(*self.given), ""
        if slot == "N":
            return (*self.name(), "name")
        if slot == "U":
            return (*self.untold(), "name")
        if slot == "S":
            return "", self.surname(), "name"
        if slot == "NR":
            return (*self.russian(), "name")
        if slot == "NC":
            return "", self.pick(*pii_words.HAN_SURNAMES) + self.pick("建国", "丽", "晓燕", "志强", "雨桐", "静", "海涛"), "name"
        if slot == "NK":
            return "", self.pick(*pii_words.JAPANESE_SURNAMES) + self.pick("", " ") + self.pick("翔太", "美咲", "健一", "花子", "直樹", "優"), "name"
        if slot == "E":
            return (*self.email(), "email")
        if slot[0] == "P":
            masks = {"P": (), "PB": ("1##########", "0##-########"), "PJ": ("0#-####-####", "0##-####-####")}[slot]
            return ("", self.digits(self.pick(*masks)), "phone") if masks else (*self.phone(), "phone")
        return (*self.street(slot), "address") if slot[0] == "A" else (*self.number(slot), "id_number")

    def sentence(self, template: str) -> tuple[str, list[tuple[int, int, str]]]:
        text, gold = "", []
        titled = "~" in template
        template = template.replace("~", "")
        for part in re.split(r"(\{\w+\})", template):
            if part.startswith("{"):
                before, got, kind = self.value(part[1:-1])
                if kind == "name" and titled:
                    before = ""
                text += before
                if kind:
                    gold.append((len(text), len(text) + len(got), kind))
                text += got + (">" if before == "<" else "")
            else:
                text += self.digits(part)
        if self.r.random() < 0.3 and (gaps := [i for i, c in enumerate(text) if c == " "]):
            at = self.r.choice(gaps)  # a line ends here
            text = f"{text[:at]}\n{text[at + 1 :]}"
        return text, gold


#: Sentences without anything to find, between the others.
FILL = ("The lift is out of order. ", "Heavy rain is expected. ", "Der Flur wird gestrichen. ", "Le bureau ferme tôt. ", "La oficina abre tarde. ", "O prazo termina hoje. ", "Biuro jest nieczynne. ", "Работа закончена. ", "会议改期。", "会議は延期された。", "", "", "")


def training_set(n: int = SENTENCES, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, gold segments) of ``n`` made-up texts, half of their sentences traps without any."""
    make = _Maker(seed)
    true, false = (x.replace("\\n", "\n").split("\0") for x in ("\0".join(TEMPLATES.splitlines()), "\0".join(TRAPS.splitlines())))
    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(make.r.randrange(1, 4)):
            text += make.pick(*FILL)
            more, segments = make.sentence(make.pick(*(true if make.r.random() < 0.5 else false)))
            gold += [(s + len(text), e + len(text), k) for s, e, k in segments]
            text += more + make.pick(" ", " ", "\n")
        out.append((text, gold))
    return out


def _logadd(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _lattice(segments: Sequence[Segment]) -> tuple[list[int], dict[int, int]]:
    bounds = sorted({x for s in segments for x in s[:2]})
    return bounds, {b: i for i, b in enumerate(bounds)}


def marginals(segments: Sequence[Segment], scores: Sequence[float]) -> list[float]:
    """Probability of each segment under the field: forward and backward sums over all labellings."""
    bounds, at = _lattice(segments)
    n = len(bounds)
    ends: list[list[int]] = [[] for _ in range(n)]
    starts: list[list[int]] = [[] for _ in range(n)]
    for i, s in enumerate(segments):
        ends[at[s[1]]].append(i)
        starts[at[s[0]]].append(i)
    forward, backward = [0.0] * n, [0.0] * n
    for p in range(n):
        total = forward[p - 1] if p else 0.0
        for i in ends[p]:
            total = _logadd(total, forward[at[segments[i][0]]] + scores[i])
        forward[p] = total
    for p in range(n - 1, -1, -1):
        total = backward[p + 1] if p + 1 < n else 0.0
        for i in starts[p]:
            total = _logadd(total, backward[at[segments[i][1]]] + scores[i])
        backward[p] = total
    z = forward[-1] if n else 0.0
    return [math.exp(forward[at[s[0]]] + w + backward[at[s[1]]] - z) for s, w in zip(segments, scores)]


def train(sentences: Sequence[tuple[str, list[tuple[int, int, str]]]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-5) -> dict[str, float]:
    """Weights by stochastic gradient on the conditional log-likelihood; gold segments without a candidate are left out."""
    data = []
    for text, gold in sentences:
        segments, truth = candidates(text), set(gold)
        if segments:
            data.append((segments, [float((s[0], s[1], s[2]) in truth) for s in segments]))
    weights: dict[str, float] = {}
    order = random.Random(SEED)
    sums: dict[str, float] = {}
    taken = 0
    for epoch in range(epochs):
        order.shuffle(data)
        step = rate / (1 + epoch)
        for n, (segments, truth) in enumerate(data):
            scores = [sum(weights.get(f, 0.0) for f in s[3]) for s in segments]
            for s, p, t in zip(segments, marginals(segments, scores), truth):
                if abs(g := t - p) > 1e-3:
                    for f in s[3]:
                        w = weights.get(f, 0.0)
                        weights[f] = w + step * (g - decay * w)
            if epoch * 2 >= epochs and n % 200 == 0:  # the mean over the second half is steadier than the last state
                taken += 1
                for f, w in weights.items():
                    sums[f] = sums.get(f, 0.0) + w
    return {f: w / taken for f, w in sums.items()} if taken else weights


@lru_cache(maxsize=1)
def fitted() -> dict[str, float]:
    """The weights, fitted once per process."""
    return train(training_set())


def decode(segments: Sequence[Segment], weights: Mapping[str, float]) -> list[tuple[int, int, str]]:
    """The labelling of greatest score: non-overlapping (start, end, kind) in order."""
    if not segments:
        return []
    bounds, at = _lattice(segments)
    ends: list[list[tuple[int, float, int]]] = [[] for _ in bounds]
    for i, s in enumerate(segments):
        w = sum(weights.get(f, 0.0) for f in s[3])
        if w > 0:
            ends[at[s[1]]].append((at[s[0]], w, i))
    best, back = [0.0] * len(bounds), [-1] * len(bounds)
    for p in range(len(bounds)):
        best[p] = best[p - 1] if p else 0.0
        for start, w, i in ends[p]:
            if best[start] + w > best[p]:
                best[p], back[p] = best[start] + w, i
    out, p = [], len(bounds) - 1
    while p >= 0:
        if back[p] >= 0:
            s = segments[back[p]]
            out.append(s[:3])
            p = at[s[0]]
            # what ends exactly where this one starts may still follow
        else:
            p -= 1
    return out[::-1]
