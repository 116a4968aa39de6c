"""Words by which personal information is recognised in nine languages.  All are fixed values: labels of forms, roles of persons,
words of addresses, common given names and surnames, as any phrase book or public name statistic lists them."""

from __future__ import annotations


def _set(text: str) -> frozenset[str]:
    return frozenset(w.replace("_", " ") for w in text.split())


#: What the number, address or name behind it is.
ID_LABELS = _set("""ssn social_security social_security_no social_security_number ss_no passport passport_no passport_number passport_nr tax_id taxpayer_id tax_no tax_number taxpayer_number national_id national_identity national_identity_no
national_id_number identity_number identity_card id_card id_card_no id_no id_number personal_number nino ni_number national_insurance national_insurance_no national_insurance_number tin itin id
steuer-id steueridentifikationsnummer steuernummer steuer-nr personalausweis personalausweisnummer ausweis ausweisnummer reisepass reisepassnummer passnummer pass sozialversicherungsnummer rentenversicherungsnummer
sécurité_sociale numéro_de_sécurité n°_de_sécurité nir passeport passeport_n° carte_d'identité numéro_fiscal dni nif nie pasaporte documento seguridad_social número_de_identidad
cpf rg bi cc passaporte contribuinte número_fiscal bilhete_de_identidade cartão_de_cidadão pesel nip dowód dowodu dowód_osobisty paszport paszportu numer_pesel паспорт паспорта паспорт_серия снилс инн паспортные_данные""")
PHONE_LABELS = _set("""tel telephone phone phone_no phone_number mobile cell cellphone fax call ring dial text sms whatsapp hotline helpline telefon telefonnummer tel-nr handy handynummer mobil mobilnummer rufnummer durchwahl anrufen ruf
téléphone tél portable mobile appeler appelez joindre téléphonez teléfono móvil celular llame llamar llame_al telf telefone telemóvel ligue ligar ligar_para celular contacto_telefónico telefonu telefonicznie zadzwoń dzwoń komórka kom nr_tel
тел телефон телефону мобильный моб звоните позвоните факс номер_телефона number""")
EMAIL_LABELS = _set("""e-mail email mail e-mail_address email_address write_to reply_to send_to contact mailto courriel mél adresse_e-mail écrire écrivez_à correo correo_electrónico escriba_a envie_para escreva_para endereço_eletrónico
e-mailadresse schreiben_sie_an mail_an adres_e-mail mailowy napisz_na почта эл_почта электронная_почта пишите_на""")
ADDRESS_LABELS = _set("""address home_address postal_address mailing_address live_at lives_at lived_at living_at lives_in resides_at residing_at reside_at resident_at deliver_to delivered_to delivery_to ship_to shipped_to send_to sent_to returned_to return_to mail_to moved_to premises_at located_at property_at house_at flat_at at
anschrift adresse wohnhaft wohnt_in wohnhaft_in wohnt lieferadresse postanschrift adresse_postale habite habite_au demeurant demeurant_au domicilié domicilié_au réside livrer_au domicilio dirección vive_en reside_en con_domicilio_en domiciliado_en enviar_a entregar_en
morada endereço residente_na residente_em mora_na mora_em reside_na entregar_na adres zamieszkały zamieszkała zamieszkały_przy zamieszkała_przy mieszka_przy adres_zamieszkania адрес по_адресу проживает проживает_по_адресу прописан зарегистрирован""")
PERSON_LABELS = _set("""contact contacts name names full_name surname signed signature sincerely regards greetings cheers wishes love yours yours_sincerely dear attn attention patient customer client applicant tenant landlord student pupil teacher tutor employee manager director nurse driver witness sender recipient owner holder member
borrower reader reviewer librarian visitor guest passenger claimant defendant plaintiff beneficiary subscriber supervisor secretary assistant colleague author editor translator mother father brother sister wife husband son daughter neighbour neighbor friend cousin uncle aunt
contact_person prepared_by written_by approved_by checked_by signed_by reviewed_by reported_by taken_by named person
ansprechpartner ansprechpartnerin name kunde kundin patientin mieter mieterin schüler lehrerin lehrer leser leserin mitarbeiter mitarbeiterin zeuge zeugin herr herrn frau unterzeichnet gez verfasser bearbeiter leiter leiterin inhaber
nom client cliente patiente locataire élève professeur lecteur lectrice salarié témoin signé cher chère emprunteur responsable gérant
nombre cliente paciente inquilino alumno alumna profesor lector lectora empleado testigo firmado estimado estimada atentamente titular encargado encargada señor señora prestatario
nome cliente paciente inquilino aluno aluna leitor leitora funcionário testemunha assinado prezado prezada titular responsável utente
imię nazwisko klient klientka pacjent pacjentka najemca uczeń czytelnik czytelniczka pracownik świadek podpisano podpisał szanowny szanowna pan pani właściciel osoba kontaktowa
имя фио клиент пациент читатель сотрудник свидетель подпись подписал уважаемый уважаемая владелец заявитель заявителя получатель отправитель гражданин гражданка студент""")
#: Words before persons, and before much else.
PERSON_HINTS = _set("""by from thank thanks ask asked ask_for met meet call called tell told with invite invited passed_to according_to behalf_of belongs_to for von bei mit ist avec par auprès_de remercie remercions contacter con por com dzwonić благодарим prosić""")
CJK_LABELS = {
    "id": ("身份证号", "身份证号码", "身份证", "护照号", "护照号码", "护照", "社保号", "纳税人识别号", "证件号码", "マイナンバー", "個人番号", "旅券番号", "パスポート番号", "免許証番号", "納税者番号"),
    "phone": ("电话", "电话号码", "手机", "手机号", "手机号码", "致电", "联系电话", "传真", "電話", "電話番号", "携帯", "携帯電話", "内線", "お電話は"),
    "email": ("邮箱", "电子邮件", "邮件", "邮件至", "电邮", "メール", "メールアドレス", "連絡先", "連絡先は"),
    "address": ("住址", "地址", "家庭住址", "住在", "寄往", "寄到", "送至", "住所", "住所は", "所在地", "お届け先"),
    "person": ("联系人", "姓名", "客户", "患者", "读者", "学生", "员工", "经办人", "申请人", "签名", "尊敬的", "收件人", "负责人", "氏名", "お名前", "担当", "担当者", "患者名", "利用者", "署名", "宛先", "責任者", "申請者"),
    "thing": ("订单", "订单号", "编号", "型号", "版本", "注文番号", "注文", "型番", "第", "共", "约", "全", "図", "表", "页", "頁"),
}
#: What numbers of other things stand behind.
THING_LABELS = _set("""order order_no order_number invoice invoice_no isbn issn doi ticket case case_no file file_no ref reference batch lot serial serial_no serial_number part part_no model version build release release_no revision sheet page pages pp p fig figure table chapter section vol volume issue edition item article
flight train room gate box shelf shelf_mark accession accession_no catalogue_no catalog_no barcode sku asset account iban card grant grant_no contract contract_no project licence patent coordinates node host port ip step line row rev no nr number_of about approximately nearly over total of
bestellung bestellnummer auftrag auftragsnummer rechnung rechnungsnummer artikel artikelnummer seite seiten band heft abb tabelle kapitel konto vertrag aktenzeichen az kundennummer
commande facture réf référence dossier lot article page tome numéro pedido factura referencia expediente lote artículo página encomenda fatura processo lote artigo zamówienie zamówienia faktura faktury sygnatura partia strona strony
заказ заказа счёт договор артикул партия страница стр рис таблица глава номер_заказа version_number""")
#: Where a place is said to be, and articles: what follows is rarely a person.
PLACE_LEFT = _set("in at near around across through towards outside inside into over under visit between throughout im beim nahe bei aus dans à près_de vers en cerca_de em perto_de w na we koło z в во на около из города city town village river lake mount")
ARTICLES = _set("the a an this that each every der die das den dem des ein eine einen einer le la les l' un une el los las una o os as um uma этот эта")
AND = _set("and und et y e i и & oraz sowie or oder ou и")
#: What a capitalised word is the name of when one of these stands in it or behind it.
THINGS = _set("""press institute institut instituto instytut university universität université universidad universidade uniwersytet college school academy akademie verlag gmbh ag kg ltd limited inc llc plc co corp corporation company group holding bank society association foundation trust council committee ministry department agency office bureau library museum gallery theatre hospital clinic church cathedral hotel club union party team lab laboratory labs centre center station airport
method methode method's number theorem equation effect law lemma test scale index model algorithm distribution process constant syndrome disease principle filter transform function criterion coefficient curve cycle unit units engine valve pump sensor protocol standard system systems theory survey report handbook manual guide design journal review archive archives collection programme program project conference award prize edition series
street road lane avenue square bridge lake river bay mountain mount mountains island islands valley forest park county city town village district region province coast sea ocean harbour harbor port castle tower hill hills creek falls canyon desert plain basin reservoir dam canal gulf strait peninsula north south east west upper lower new old great saint san santa
verfahren zahl satz gesetz effekt skala straße platz see fluss brücke berg tal wald insel stiftung verein museum schule klinik méthode loi théorème effet nombre société fondation musée école hôpital fleuve lac rivière mont método ley teorema efecto número sociedad fundación museo escuela río lago monte método lei museu escola rio metoda prawo twierdzenie liczba muzeum szkoła rzeka jezioro most метод закон теорема эффект число институт университет музей школа река озеро мост завод издательство""")
#: What stands behind numbers of other things.
UNITS = _set("kg g mg t km m cm mm m² m³ l ml °c % percent eur usd gbp pln hours hrs min minutes seconds days weeks months years pages cases items units readings samples rows records copies volumes words points times stück seiten fälle heures jours pages unités días páginas casos unidades dias sztuk stron przypadków штук страниц случаев")
#: What persons do.
VERBS = _set("""said says wrote writes asked asks told called calls lives lived works worked signed signs left arrived phoned reported reports reports agreed agrees confirmed came went has had will was is who whose paid bought teaches borrowed returned requested joined
sagte schrieb wohnt arbeitet hat war ist wird rief unterschrieb erhielt a dit écrit habite travaille était est sera qui appelle dijo escribe vive trabaja fue es será llamó firmó disse escreve mora trabalha foi assinou powiedział powiedziała mieszka pracuje napisał podpisał jest był była сказал сказала живёт работает написал написала подписал пришёл был была""")
TITLES = _set("mr mrs ms miss mx dr prof professor sir madam madame mme mlle monsieur m herr herrn frau sr sra srta don doña dom dona dña pan pani г-н г-жа д-р проф господин госпожа dipl ing rev capt sgt nurse judge")
CJK_HONORIFICS = ("先生", "女士", "小姐", "老师", "教授", "同学", "さん", "様", "氏", "さま", "くん", "ちゃん", "医生")
PARTICLES = _set("de da do dos das del di du des van von ten ter zu zum af av al el bin ibn ben")
#: What may stand behind a particle.
PARTICLE_ENDS = _set("la las los der den")
#: Words that begin sentences and are no part of a name.
FUNCTION_WORDS = _set("""above below under over between among against within beyond along behind beside the a an and or but if when while where who what which this that these those it its he she they we you i his her their our your my in on at by for from with without to of as is are was were be been has have had do does did not no yes all any each every some most many more other after before since until during then there here how why once only also even both either neither please
see note further next first last another such so thus because although however therefore der die das den dem ein eine und oder aber wenn als wie wo wer was dieser diese dieses es er sie wir ihr ich nicht kein alle jeder nach vor seit bis mit ohne für von zu bei im am an auf aus ist sind war le la les un une des et ou mais si quand ce cette ces il elle ils elles nous vous je ne pas tout tous chaque après avant depuis avec sans pour par dans sur est sont
el los las una y o pero cuando este esta estos se no todo todos cada después antes desde con sin para por en es son os as um uma e mas quando isto não todos depois antes com sem em w we na z ze do od po przed nie tak jest są ten ta to te i lub ale gdy jeśli każdy и или но если когда это этот эта эти он она они мы вы я не все каждый после до с без для от в на по из как так""")
#: Common given names of many countries; with the forms of names.py and any word that stands like one, evidence and no condition.
GIVEN_NAMES = _set("""john mary james patricia robert jennifer michael linda david susan william karen richard sarah thomas emma oliver amelia george olivia harry emily jack charlotte daniel jessica matthew laura andrew rachel paul helen peter anna mark julia simon alice edward kate
hans jürgen björn ingrid monika klaus sabine stefan petra andreas katrin lukas leonie felix hannah max lena jean marie pierre camille julien hélène antoine chloé nicolas léa quentin manon louis yvonne zoé françois claire josé maría juan carmen luis ximena carlos lucía javier elena miguel sofía diego pablo tomás beatriz
joão ana pedro inês rui teresa tiago rita paulo fernanda marcos camila jan katarzyna piotr agnieszka łukasz małgorzata krzysztof ewa tomasz zofia marek barbara giulia marco luca chiara lars astrid erik freya fatima mohammed ahmed aisha omar layla hassan yusuf priya rahul arjun ananya wei li ming nguyen linh minh kenji yuki hiroshi sakura kim min olga ivan""")
GIVEN_CYRILLIC = _set("александр алексей анна андрей борис вадим василий вера виктор антон владимир галина григорий дарья дмитрий евгений екатерина елена иван игорь ирина кирилл ксения людмила максим мария михаил надежда наталья никита николай оксана олег ольга павел пётр роман светлана сергей софия татьяна юлия юрий")
#: Most frequent Chinese surnames, and Japanese ones of two characters.
HAN_SURNAMES = tuple("王李张張刘劉陈陳杨楊赵趙黄黃周吴吳徐孙孫胡朱高林何郭马馬罗羅梁宋郑鄭谢謝韩韓唐冯馮于董萧程曹袁邓鄧许許傅沈曾彭吕呂苏蘇卢盧蒋蔣蔡贾丁魏薛叶葉余潘杜戴夏钟汪田任姜范方石姚")
JAPANESE_SURNAMES = tuple("佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 吉田 山田 佐々木 山口 松本 井上 木村 斎藤 清水 山崎 池田 橋本 阿部 石川 山下 中島 石井 小川 前田 岡田 長谷川 藤田 後藤 近藤 村上 遠藤 青木 坂本 福田 太田 西村 藤井 金子 岡本 藤原 三浦 中野 原田 松田 竹内".split())
#: Words that end, or begin, the name of a street.
STREETS = _set("street st road rd lane ln avenue ave row court ct drive dr way close place pl terrace square sq boulevard blvd crescent cres gardens grove mews hill walk quay parade circle trail highway hwy rise green view yard")
STREET_ENDS = ("straße", "strasse", "str", "weg", "platz", "gasse", "allee", "ring", "damm", "ufer", "steig", "chaussee")
STREET_FIRST = ("rue", "avenue", "boulevard", "bd", "place", "impasse", "chemin", "quai", "allée", "cours", "route", "calle", "c/", "avda", "avenida", "paseo", "plaza", "plz", "camino", "av", "rua", "travessa", "largo", "praça", "estrada", "ul", "al", "pl", "os", "aleja", "ulica", "ulicy", "via", "viale", "piazza", "ул", "улица", "улице", "пр", "просп", "проспект", "проспекте", "пер", "переулок", "наб", "бульвар")
