"""Sentences of other wording and names than the field is fitted on; items are marked [kind:text]."""

HELD_OUT = """
We spoke with [name:Fatima Haddad] yesterday; her cell is [phone:07700 900123].
The new treasurer, [name:Dinesh Ramachandran], lives near the harbour.
Employee [name:Wei Zhang] handed in badge and keys. His SSN is [id_number:123-45-6789].
For the lease, contact [name:Nguyen Van Minh] under [phone:+84 24 3825 1234].
National Insurance number: [id_number:QQ 12 34 56 C].
He has lived at [address:14 Elm Crescent, Dover] for ten years.
Drop a line to [email:anna at lib dot example] if anything is missing.
Dear [name:Mrs Dalloway],\\nyour appointment is confirmed.
The package should go to [address:221B Baker Street, London].
Dr. [name:Okonkwo] wrote the prescription for [name:Ifeoma Adeyemi].
Witness: [name:Siobhan O'Connor], telephone [phone:020 7946 0018].
Guest list: [name:Marta Kowalczyk], [name:Tariq Aziz], [name:Grace Hopper].
Passport no. [id_number:X1234567] was stamped twice.
Tenant: [name:Kwame Mensah]; [email:k.mensah+flat@housing-trust.org.uk]
Payment was received from [name:Eleanor Rigby] on Tuesday.
Call me back on [phone:(415) 555-2671] or [phone:415-555-2672].
[name:Amara Diallo] said she would send it to [email:amara_diallo@uni-lyon.fr].
Taxpayer ID [id_number:987-65-4320] appears on the form of [name:Luis Fernando Ortega].
The flat at [address:7 Rosewood Avenue, Leeds] is empty; ask [name:Rajesh Koothrappali] for keys.
Regards,\\n[name:Björn Ulvaeus]
The conductor [name:Mirga Gražinytė] was applauded.
Our vet, Dr. [name:Helen Cho], is available at [phone:+1 212 555 0187].
Patient [name:Zainab Al-Hashimi] was discharged to [address:3 Chapel Lane, York].
Frau [name:Schneider] ist unter [phone:030 901820] erreichbar.
Der Bewohner [name:Mehmet Yıldız], [address:Lindenallee 5, 50668 Köln], wurde befragt.
Bitte senden Sie Unterlagen an [email:bewerbung@firma-muster.de].
Herr [name:Vogelsang] unterschrieb den Vertrag; Steuer-ID [id_number:12 345 678 901].
Zeuge: [name:Anselm Krüger], wohnhaft [address:Bahnhofstraße 12a, 80335 München].
L'élève [name:Aminata Traoré] est absente; sa mère habite [address:8 rue Victor Hugo, 69002 Lyon].
Monsieur [name:Lefebvre] a appelé le [phone:01 42 68 53 00].
Numéro de sécurité sociale : [id_number:1 85 05 78 006 084 36].
Merci de répondre à [email:secretariat@mairie-test.fr].
El señor [name:Aurelio Buendía] reside en [address:Calle Mayor 15, Madrid].
La titular [name:Rosalía Castro], DNI [id_number:12345678Z], firmó ayer.
Llame al [phone:912 345 678] por la tarde.
A aluna [name:Benedita Souza] mudou-se para [address:Rua Augusta 210, Lisboa].
O cliente [name:Thiago Alencar], CPF [id_number:123.456.789-09], telefonou.
Klient [name:Zbigniew Nowak], PESEL [id_number:44051401359], prosi o kontakt.
Mieszka przy [address:ul. Długa 7, Kraków]; telefon [phone:601 234 567].
Сотрудник [name:Иван Петров] живёт по адресу [address:ул. Ленина, д. 25].
Паспорт [id_number:4509 123456], телефон [phone:+7 912 345-67-89].
Заявление подал [name:Сидоров П. И.]
联系人：[name:陈美玲]，手机 [phone:13800138000]。
身份证号码：[id_number:11010519491231002X]
请寄到[address:北京路12号]。
患者[name:李伟]的邮箱是 [email:liwei@yiyuan.cn]。
担当は[name:高橋健太]です。電話 [phone:03-1234-5678]
住所：[address:東京都千代田区丸の内1-2-3]
個人番号 [id_number:1234 5678 9012] を提出した。
連絡先 [email:info@kaisha.jp] 、[name:鈴木一郎]様
The Doppler effect and the Mohs scale are explained in chapter 7.
Cambridge University Press, Oxford Street branch, stocks it.
Lake Victoria and Mount Elbrus lie far apart.
Order 112-4455-667788 shipped on 2021-03-04; total 1,204.50 EUR.
ISBN 978-3-16-148410-0, pages 112-134.
The John Hancock Center is a tower; the Johns Hopkins Hospital is not.
Article 4711-2233 costs 19.99; item no. 123456789 is sold out.
Version 10.4.22.1 runs on 192.168.10.24.
Der Alte Markt und die Neue Brücke sind gesperrt.
Le Mont Blanc et la Société Générale.
El Río Grande y la Ciudad Universitaria.
Serial number 555-12-9876 of the pump was read.
New York City Council met in Central Park.
Quarterly Sales Report For Northern Regions
Use the Runge Kutta method with 1000 0000 steps.
At 51.507351, -0.127758 the gauge stands.
Институт Курчатова находится в Москве.
华东师范大学在上海市。订单号 20210304112233。
図書館は京都市にある。版本 2.0.1。
Meetings take place every Monday and Thursday in July.
The Ministry of Health and the World Bank agreed on 12 March 2019.
""".strip()

#: Written after the last change to the field and its templates; evaluated as it is.
UNSEEN = """
Our architect is [name:Leila Farahani]; her studio number is [phone:+44 7911 123456].
Could [name:Marcus Aurelio] please collect the umbrella?
I have sold the bicycle to [name:Olumide Bakare], [address:52 Harbour Street, Bristol].
The invoice was sent to [email:accounts@green-valley.co.uk] last night.
[name:Charlotte Brontë] borrowed three books.
Emergency contact: [name:Pedro Almodovar], mobile [phone:0176 5550142].
Members: [name:Anna Freud], [name:Carl Jung], [name:J. Lacan].
His tax number [id_number:12 345 678 901] is wrong.
Her identity card no. [id_number:AB1234567] was found by [name:Tomasz Zieliński].
A letter from [name:Hannah Arendt] lay on the desk.
The dentist, Dr. [name:Yamada], is on holiday.
You can write to my lawyer at [email:m.lopez@bufete.example].
Delivery address: [address:9 Mill Lane, Norwich].
If no one answers, dial [phone:555-0143] or [phone:(312) 555-0199].
Her husband [name:Vikram Seth] works at the mill.
Best wishes\\n[name:Ngozi Okafor]\\n[address:31 Beech Road, Hull]
Frau [name:Lindqvist] hat die Nummer [phone:0221 4710123].
Der Nachbar [name:Uwe Timm] wohnt in [address:Gartenweg 3, 28195 Bremen].
Antworten an [email:info@verein-nord.de] oder telefonisch unter [phone:+49 421 123456].
La voisine [name:Simone Weil] est partie.
Écrivez à [email:contact@atelier.fr] ou passez au [address:24 avenue Foch, 54000 Nancy].
El vecino [name:Octavio Paz] vive en [address:Avda. Libertad 88, Sevilla].
NIE [id_number:X1234567L] a nombre de [name:Gabriela Mistral].
A vizinha [name:Clarice Lispector] ligou para [phone:+351 21 123 4567].
Pani [name:Szymborska] mieszka przy [address:ul. Krupnicza 22, Kraków].
Telefon kontaktowy: [phone:+48 601 202 303].
Доктор [name:Антон Чехов] принимает по адресу [address:ул. Малая, д. 6].
Телефон: [phone:8 (495) 123-45-67].
收件人：[name:张伟]，电话：[phone:010-62345678]
请联系[name:刘洋]，邮箱 [email:liuyang@gongsi.cn]。
署名：[name:中村 明]
電話番号：[phone:06-6123-4567]
The Geiger counter and the Richter scale are shown in Fig. 3.
Trafalgar Square and Hyde Park were full.
Invoice 2020-118-4432 lists 300 400 500 items.
Batch 123-45-678 passed; room 555-1.
Programme: Opening Speech, Lunch Break, Closing Remarks
Kapitel 4: Allgemeine Bestimmungen
Capítulo 2: Medidas Generales
Rozdział 3: Postanowienia Ogólne
The Royal Society met the French Academy in Paris.
Temperature 0123 456 at 12:30, pressure 1013.25.
""".strip()

#: Written after the last change to the field and its templates; evaluated as it is.
LAST = """
My aunt [name:Wangari Maathai] planted the trees.
Have you seen [name:Arundhati Roy] today?
The violinist [name:Hilary Hahn] opened the season.
Parcels for [name:Tawakkol Karman] go to [address:18 Orchard Road, Exeter].
Send the keys to [email:keys@flatshare.example], not to me.
Since May, [name:Rigoberta Menchú] runs the shop.
Text me: [phone:07911 123456].
With love\\n[name:Elinor Ostrom]
Payroll | [name:Malala Yousafzai] | [id_number:234-56-7890] | [phone:020 7123 4567] |
Please thank [name:Ellen Johnson] for the cake.
[name:Shirin Ebadi] wrote that the roof leaks.
Passport [id_number:ZE000509], holder [name:Leymah Gbowee].
He rents [address:4 Priory Close, Lincoln] from [name:Svetlana Alexievich].
Der Klempner [name:Heinrich Böll] kommt um neun.
Mein Bruder [name:Günter Grass] wohnt im [address:Ulmenweg 8, 23552 Lübeck].
Personalausweis Nr. [id_number:L22000129] gehört [name:Nelly Sachs].
Ma cousine [name:Annie Ernaux] a téléphoné.
Tél. [phone:04 91 22 33 44], courriel [email:a.ernaux@poste.fr]
La doctora [name:Rita Levi] llegó tarde.
DNI [id_number:87654321X], domicilio: [address:Calle Real 7, Cádiz].
O dentista [name:José Saramago] mora na [address:Rua das Flores 12, Porto].
Kuzynka [name:Olga Tokarczuk] dzwoniła wczoraj.
PESEL [id_number:92071314764], tel. [phone:512-345-678]
Сосед [name:Борис Пастернак] уехал.
ИНН [id_number:12345678901], почта [email:boris@pochta.ru]
客户[name:莫言]，手机 [phone:13912345678]
担当者：[name:山田太郎]、[email:yamada@kaisha.jp]
The Geneva Convention and the Marshall Plan are taught in class.
Big Ben and the Golden Gate Bridge attract visitors.
Supplementary Material For Chapter Five
Purchase order 4500-123-987 covers 250 000 000 units.
Die Allgemeine Zeitung erscheint in Mainz.
Le Palais Royal et la Banque Nationale.
La Casa Blanca y el Banco Central.
""".strip()
