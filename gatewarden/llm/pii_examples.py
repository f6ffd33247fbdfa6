"""Training texts of the span field: sentences with made-up values in them, and what a first fit finds in the corpus.

The carrier sentences are written from general knowledge, not from the tables.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

from gatewarden.llm import pii_lexicon as lex

_SYLLABLES = "bra mar len tor vik sel dor pen hart wick ford mont ash win kel ros bel quin tal var dis lo ren gra mil han ster cot brook land er son ley field worth ham ton".split()
_CYRILLIC = "бел гор лад верш тум сел мар кол бор вет сад зор лес пет кор дуб".split()
_DEVANAGARI = "सोम वेल मधु राम कर तर नव देव हर जय पुर वाल कोट गढ़ नाडे लकर वाडी".split()
_HAN_PLACES = "清柳云梅竹松桃石溪河桥湖阳平安东南西北新长大"
_KANA = "はなけんたゆみこたかしよしおみさきりょうあいまゆ"
_THAI = "วงศ์ พงษ์ ศรี ทอง สุข ชัย รัตน์ บุญ เจริญ แก้ว".split()
_ARABIC = "الخطيب النجار الحداد المصري الشامي العلي السالم الفارس البكري القاسم الزهراني الحسيني".split()

#: Sentences with ``{v}`` in the place of a value, by language and type.
CARRIERS = {
    "en": {
        "name": "{v} sings in the choir|yesterday {v} came to see us|{v} and the children are fine|for {v} and {v}|{v} is my neighbour|thanks, {v}|give it to {v}|my name is {v}|i am {v} and i work here|this is {v} speaking|ask for {v} at the desk|{v} wrote the first draft|we met {v} at the station|please call {v} back|the letter was signed by {v}|dear {v}, thank you|kind regards, {v}|my sister {v} lives abroad|{v} said that it works|the invoice goes to {v}|i spoke with {v} about it|{v} and {v} live next door|put it in the name of {v}|the patient {v} was seen today|contact: {v}|our teacher {v} is ill|sincerely {v}",
        "phone": "my phone number is {v}|call me on {v}|call {v} for help|you can ring {v} after lunch|tel {v}|phone: {v}|text me at {v}|mobile {v}|the number of the clinic is {v}|dial {v} to talk to us|fax {v}|reach us under {v}|whatsapp {v}|my cell is {v}, thanks|is {v} still your number?",
        "id_number": "write {v} in the box for the id|my social security number is {v}|ssn: {v}|passport {v} was issued here|my passport number is {v}|national id {v}|the driver licence has the number {v}|tax id {v}|identity card no. {v}|they ask for my id, it is {v}|insurance number {v} is on the card|the id on file is {v}",
        "address": "i live at {v}|our office is at {v}|send the box to {v}|deliver it to {v}, please|the house at {v} is for sale|we moved to {v} last year|address: {v}|come to {v} at eight|the crash happened near {v}|my new home is {v}",
        "email": "{v}|the mailbox {v} is full|the login {v} is locked|hello {v}|write to {v}|my email is {v}|mail {v} for details|contact us at {v}|e-mail: {v}|send it to {v} please|{v} is my address|reply to {v} today|cc {v} on this|the account belongs to {v}",
    },
    "es": {
        "name": "ayer vino {v}|{v} es mi vecino|a nombre de {v}|me llamo {v}|soy {v} y trabajo aquí|habla {v}|pregunte por {v}|{v} escribió el texto|estimado {v}|saludos, {v}|hablé con {v}|mi hermana {v} vive lejos|firmado por {v}|contacto: {v}|conocimos a {v} ayer|{v} dijo que sí|mi profesor {v} está enfermo",
        "phone": "mi teléfono es {v}|mi número es el {v}|llama al {v}|tel. {v}|móvil {v}|puedes llamar al {v} mañana|escríbeme al {v}|el número de la clínica es {v}|whatsapp {v}",
        "id_number": "el pasaporte lleva el número {v}|mi dni es {v}|dni {v}|mi pasaporte es el {v}|número de identidad {v}|nif: {v}|mi número de la seguridad social es {v}|documento {v}|cédula {v}",
        "address": "vivo en {v}|nuestra oficina está en {v}|envíe la caja a {v}|dirección: {v}|nos mudamos a {v}|la casa de {v} se vende|entregar en {v}",
        "email": "escribe a {v}|mi correo es {v}|correo: {v}|contacto en {v}|manda la factura a {v}|responde a {v} hoy",
    },
    "fr": {
        "name": "hier {v} est venu|{v} est mon voisin|la place de {v}|je m'appelle {v}|je suis {v} et je travaille ici|ici {v}|demandez {v}|{v} a écrit le texte|cher {v}|cordialement, {v}|j'ai parlé avec {v}|ma sœur {v} vit loin|signé par {v}|contact : {v}|nous avons vu {v} hier|{v} a dit oui",
        "phone": "mon téléphone est le {v}|mon numéro est le {v}|appelez le {v}|tél. {v}|portable {v}|vous pouvez appeler le {v} demain|le numéro de la clinique est {v}|joignable au {v}",
        "id_number": "numéro de sécurité sociale : {v}|mon numéro de sécurité sociale est {v}|mon passeport est le {v}|numéro d'identité {v}|carte d'identité {v}|numéro fiscal {v}|ma carte porte le numéro {v}",
        "address": "j'habite {v}|j'habite au {v}|notre bureau est au {v}|envoyez la boîte au {v}|adresse : {v}|nous avons déménagé au {v}|livrer au {v}",
        "email": "écrivez à {v}|mon adresse est {v}|courriel : {v}|contactez-nous à {v}|envoyez la facture à {v}|répondez à {v}",
    },
    "de": {
        "name": "gestern kam {v}|{v} ist mein nachbar|im namen von {v}|für {v}|ich heiße {v}|mein name ist {v}|ich bin {v} und arbeite hier|hier spricht {v}|fragen sie nach {v}|{v} hat den text geschrieben|lieber {v}|mit freundlichen grüßen, {v}|ich sprach mit {v}|meine schwester {v} wohnt weit weg|unterschrieben von {v}|kontakt: {v}|{v} sagte ja",
        "phone": "meine telefonnummer ist {v}|meine nummer lautet {v}|rufen sie {v} an|tel. {v}|handy {v}|erreichbar unter {v}|die praxis hat die nummer {v}|ruf mich an: {v}",
        "id_number": "meine steuer-id lautet {v}|die passnummer lautet {v}|meine ausweisnummer ist {v}|reisepass {v}|meine steuernummer ist {v}|steuer-id {v}|sozialversicherungsnummer {v}|personalausweis nr. {v}|die nummer im pass ist {v}",
        "address": "der umzug nach {v} ist vorbei|ich wohne in der {v}|ich wohne {v}|unser büro ist in der {v}|schicken sie die kiste an {v}|adresse: {v}|wir sind in die {v} gezogen|lieferung an {v}",
        "email": "schreiben sie an {v}|meine adresse ist {v}|e-mail: {v}|kontakt unter {v}|senden sie die rechnung an {v}|antworten sie an {v}",
    },
    "pt": {
        "name": "ontem veio {v}|{v} é meu vizinho|em nome de {v}|meu nome é {v}|me chamo {v}|sou {v} e trabalho aqui|fala {v}|procure por {v}|{v} escreveu o texto|prezado {v}|abraços, {v}|falei com {v}|minha irmã {v} mora longe|assinado por {v}|contato: {v}|{v} disse que sim",
        "phone": "meu telefone é {v}|meu número é {v}|ligue para {v}|tel. {v}|celular {v}|pode ligar para {v} amanhã|o número da clínica é {v}|whatsapp {v}",
        "id_number": "o passaporte tem o número {v}|meu cpf é {v}|cpf: {v}|meu passaporte é {v}|número de identidade {v}|rg {v}|meu documento é {v}",
        "address": "moro na {v}|moro em {v}|nosso escritório fica na {v}|envie a caixa para {v}|endereço: {v}|mudamos para {v}|entregar na {v}",
        "email": "escreva para {v}|meu e-mail é {v}|e-mail: {v}|contato em {v}|mande a fatura para {v}|responda para {v}",
    },
    "ru": {
        "name": "вчера пришёл {v}|{v} мой сосед|от имени {v}|меня зовут {v}|моё имя {v}|я {v} и работаю здесь|говорит {v}|спросите {v}|{v} пишет текст|уважаемый {v}|с уважением, {v}|я говорил с {v}|подпись: {v}|контакт: {v}|{v} ответил вчера|письмо подписал {v}",
        "phone": "мой телефон {v}|мой номер {v}|звоните по номеру {v}|тел. {v}|мобильный {v}|можно позвонить на {v} завтра|номер клиники {v}",
        "id_number": "номер паспорта {v}|паспорт {v}|мой паспорт {v}|снилс {v}|инн {v}|номер удостоверения {v}|удостоверение {v}",
        "address": "я живу по адресу {v}|живу на {v}|наш офис: {v}|пришлите коробку на {v}|адрес: {v}|мы переехали на {v}|доставить по адресу {v}",
        "email": "пишите на {v}|моя почта {v}|почта: {v}|связь: {v}|пришлите счёт на {v}|ответьте на {v}",
    },
    "zh": {
        "name": "我叫{v}|我是{v}|我的名字是{v}|请联系{v}|请找{v}先生|{v}女士您好|{v}写了这篇文章|联系人：{v}|昨天见到了{v}|这封信由{v}签名|{v}说可以|用{v}的名义",
        "phone": "我的电话是{v}|我的手机号码是{v}|请拨打{v}|电话：{v}|打{v}找我|手机{v}|诊所的号码是{v}|我的手机是{v}",
        "id_number": "我的身份证号码是{v}|身份证：{v}|护照号码{v}|证件号{v}|身份证号是{v}|社保号{v}|表上的证件号码是{v}",
        "address": "我家在{v}|地址：{v}|请寄到{v}|我们搬到了{v}|办公室在{v}|我住{v}|送到{v}",
        "email": "我的邮箱是{v}|请写信到{v}|邮箱：{v}|发到{v}|联系{v}|回复{v}",
    },
    "ja": {
        "name": "{v}の名前で|署名は{v}で|私は{v}です|私の名前は{v}です|{v}と申します|{v}さんに電話してください|{v}様へ|担当は{v}です|{v}が書きました|昨日{v}さんに会いました|署名は{v}|連絡先：{v}",
        "phone": "電話番号は{v}です|私の携帯は{v}です|電話：{v}|{v}に電話してください|携帯{v}|{v}までお電話を",
        "id_number": "マイナンバーは{v}です|旅券番号は{v}です|身分証の番号は{v}です|パスポート{v}|免許証番号{v}|番号は{v}と書いてください",
        "address": "箱は{v}へ送ります|{v}まで荷物を届けて|住所は{v}です|住所：{v}|{v}に住んでいます|{v}に送ってください|事務所は{v}にあります|{v}へ引っ越しました",
        "email": "メールは{v}です|{v}に送ってください|メール：{v}|{v}までご連絡ください|連絡は{v}まで",
    },
    "ar": {
        "name": "اسمي {v}|أنا {v} وأعمل هنا|اسأل عن {v}|كتب {v} النص|السيد {v} مريض|مع التحية {v}|تحدثت مع {v}|توقيع {v}|جهة الاتصال: {v}|قال {v} نعم",
        "phone": "رقم هاتفي {v}|اتصل على {v}|هاتف {v}|جوال {v}|رقم العيادة {v}|يمكنك الاتصال بالرقم {v}",
        "id_number": "رقم هويتي {v}|رقم الجواز {v}|جواز سفر {v}|الرقم الوطني {v}|بطاقة الهوية {v}",
        "address": "أسكن في {v}|عنواني {v}|مكتبنا في {v}|أرسل الصندوق إلى {v}|العنوان: {v}",
        "email": "بريدي {v}|اكتب إلى {v}|البريد: {v}|أرسل الفاتورة إلى {v}",
    },
    "hi": {
        "name": "मेरा नाम {v} है|मैं {v} हूँ|{v} से बात करें|{v} ने लिखा|प्रिय {v}|सादर, {v}|संपर्क: {v}|कल {v} से मिले|हस्ताक्षर {v} के हैं|{v} ने हाँ कहा",
        "phone": "मेरा फ़ोन नंबर {v} है|मेरा नंबर {v} है|फ़ोन: {v}|{v} पर फ़ोन करें|मोबाइल {v}|क्लिनिक का नंबर {v} है",
        "id_number": "मेरा आधार नंबर {v} है|पासपोर्ट {v}|पहचान संख्या {v}|आधार: {v}|पैन {v}|मेरी पहचान संख्या {v} है",
        "address": "मैं {v} में रहता हूँ|पता: {v}|डिब्बा {v} पर भेजें|हमारा दफ़्तर {v} में है|मेरा पता {v} है",
        "email": "मेरा ईमेल {v} है|{v} पर लिखें|ईमेल: {v}|बिल {v} पर भेजें",
    },
    "th": {
        "name": "ฉันชื่อ {v}|ผมชื่อ {v}|ชื่อ {v}|ติดต่อ {v}|{v} เป็นคนเขียน|เรียน {v}|ลงชื่อ {v}|เมื่อวานเจอ {v}",
        "phone": "เบอร์โทรของฉันคือ {v}|โทร {v}|เบอร์ {v}|มือถือ {v}|โทรหาฉันที่ {v}",
        "id_number": "เลขบัตรประชาชน {v}|หนังสือเดินทาง {v}|เลขประจำตัว {v}|บัตรเลขที่ {v}",
        "address": "ฉันอยู่ที่ {v}|ที่อยู่ {v}|ส่งกล่องไปที่ {v}|บ้านอยู่ที่ {v}",
        "email": "อีเมลของฉันคือ {v}|เขียนมาที่ {v}|อีเมล {v}|ส่งใบเสร็จไปที่ {v}",
    },
}
#: Sentences without personal information: ``{c}`` is a company or product, ``{o}`` an order code or serial number, ``{q}`` an amount, ``{w}`` an address of a network, a version, a date or a time.
PLAIN = {
    "en": "tags: {c}, {c}, {c}|list: {c}, {c}, {c}, {c}|the {c} mark {q} is a good model|model {c} mk {q}|Mark your calendar for {w}|Grace and patience help|mr. chairman, the vote is open|the madam chair of {c} agreed|Dear customers of {c}|the offer of {c} ends soon|{c} launched a lamp in spring|compare {c} with {c} and {c}|the order {o} is late|invoice {o} was paid|order no. {o} reached {c}|ticket {o} is closed|the stamp says {o}|parcel {o} left the depot|serial number {o}|version {w} fixed it|the server {w} is down|the log shows {w}|about {q} people came|it costs {q} credits|{q} percent of {q} visits came from {c}|between {q} and {q} rows|{c} hired two people|the driver from {c} waited|ask {c} for a quote|the desk of {c} ltd.|brands: {c}, {c} and {c}|our kitchen team answers|the new driver said hello|on {w} the shop of {c} closed|the president of the club spoke|between {c} and {c} i prefer {c}|lot {q} of {o}|tell {c} that the price is {q}|we sold {q} units of it|Last Summer the Old Bridge was closed|Teachers and Nurses like it",
    "es": "lista: {c}, {c}, {c}|el sr. presidente de {c} votó|la sra. gerente de {c} opina|señor cliente|la oferta de {c} termina|compara {c} con {c}|el pedido {o} llega tarde|la factura {o} es de {c}|la versión {w} lo arregla|cuesta {q} euros|unas {q} visitas de {c}|el gerente de {c} llamó|nadie en {c} lo sabe|el {q} por ciento|paquete {o}|marcas: {c}, {c}",
    "fr": "liste : {c}, {c}, {c}|monsieur le maire de {c} a voté|madame la présidente de {c} pense|cher client|l'offre de {c} se termine|compare {c} avec {c}|la commande {o} est en retard|la facture {o} vient de {c}|la version {w} le corrige|cela coûte {q} euros|environ {q} visites de {c}|le gérant de {c} a appelé|personne chez {c} ne sait|{q} pour cent|colis {o}|marques : {c}, {c}",
    "de": "Liste: {c}, {c}, {c}|der herr direktor von {c} stimmte ab|frau präsidentin, die wahl ist offen|liebe kunden|das angebot von {c} endet|vergleiche {c} mit {c}|die bestellung {o} ist spät|rechnung {o} gehört zu {c}|version {w} behebt es|es kostet {q} euro|etwa {q} besuche von {c}|der leiter bei {c} rief an|niemand bei {c} weiß es|{q} prozent|paket {o}|Marken: {c}, {c}|Die Lehrer und die Schüler warten",
    "pt": "lista: {c}, {c}, {c}|o sr. gerente da {c} votou|a sra. presidente da {c} opina|caro cliente|a oferta da {c} termina|compare {c} com {c}|o pedido {o} atrasou|a fatura {o} é da {c}|a versão {w} corrige|custa {q} reais|cerca de {q} visitas da {c}|o gerente da {c} ligou|ninguém na {c} sabe|{q} por cento|pacote {o}",
    "ru": "список: {c}, {c}, {c}|господин директор {c} голосует|уважаемые клиенты|предложение {c} кончается|сравни {c} и {c}|заказ {o} опаздывает|счёт {o} от {c}|версия {w} исправлена|стоит {q} рублей|около {q} посещений {c}|менеджер {c} звонил|никто в {c} не знает|{q} процентов|посылка {o}",
    "zh": "向学生说明这本书|向年轻司机介绍规则|向老年顾客解释价格|给业主写通知|帮护士准备讲稿|告诉医生你的症状|替律师写回复|给周末游客写信|为农民提供贷款|向程序员说明{c}|给高中老师写一段话|让夏令营学员看地图|向水管工提问|对余下的人说明|清单：{c}、{c}、{c}|小猫在睡觉|旧桌子已经卖了|{c}的优惠结束了|比较{c}和{c}|订单{o}迟到了|发票{o}来自{c}|版本{w}已修复|价格是{q}元|大约{q}次访问来自{c}|{c}的经理来电话了|百分之{q}|包裹{o}|老师喜欢这本书",
    "ja": "料理人に説明する|医者と看護師に知らせる|若い運転手への返事|毛のぼうしを買う|旅行者のための地図|花の好きな人へ|小さな箱を買いました|大きな家に住みたい|古いかばんが好きです|新しいやり方を試す|青いかさを忘れました|小さなねこがいる|静かなみせで待つ|丸いつくえが届いた|長いはしごを借りた|熱いおちゃを飲む|短いことばで書く|一覧：{c}、{c}、{c}|{c}の割引は終わります|{c}と{c}を比べて|注文{o}は遅れています|請求書{o}は{c}のものです|版{w}で直りました|価格は{q}円です|約{q}回の訪問|{c}の担当者が来ました|{q}パーセント|荷物{o}|先生はこの本が好き",
    "ar": "قائمة: {c}، {c}، {c}|ينتهي عرض {c}|قارن {c} مع {c}|الطلب {o} متأخر|الفاتورة {o} من {c}|الإصدار {w} جاهز|السعر {q} دينار|نحو {q} زيارة من {c}|اتصل مدير {c}|{q} في المئة",
    "hi": "सूची: {c}, {c}, {c}|{c} का प्रस्ताव समाप्त है|{c} और {c} की तुलना करें|ऑर्डर {o} देर से है|बिल {o} {c} का है|संस्करण {w} ठीक है|कीमत {q} रुपये है|लगभग {q} लोग आए|{c} के प्रबंधक ने फ़ोन किया|{q} प्रतिशत",
    "th": "รายการ {c}, {c}, {c}|ข้อเสนอของ {c} หมดแล้ว|เปรียบเทียบ {c} กับ {c}|คำสั่งซื้อ {o} ล่าช้า|ใบแจ้งหนี้ {o} ของ {c}|รุ่น {w} แก้แล้ว|ราคา {q} บาท|ผู้จัดการของ {c} โทรมา|ร้อยละ {q}",
}
#: Telephone and identity number formats in use, ``d`` a digit, ``D`` one from 1 to 9, ``L`` a letter.
PHONES = "+1 ddd ddd dddd|(ddd) ddd-dddd|ddd.ddd.dddd|ddd-ddd-dddd|ddd ddd dddd|+44 dddd dddddd|0dddd dddddd|0dddd ddd ddd|001dddddddddd|00dd dd dddddddd|+34 ddd dd dd dd|ddd dd dd dd|ddd ddd ddd|dddd ddddd|+33 d dd dd dd dd|0d.dd.dd.dd.dd|0d dd dd dd dd|+49 ddd ddddddd|+49 dd ddddd ddd|0dd/ddddd-ddd|0ddd ddddddd|+55 dd ddddd-dddd|(dd) ddddd dddd|(dd) ddddd-dddd|+7 (ddd) ddd-dd-dd|8 ddd ddd dddd|8 (ddd) ddd-dd-dd|+86 ddd dddd dddd|1dddddddddd|+81 dd-dddd-dddd|0dd-dddd-dddd|0d-dddd-dddd|+91 ddddd ddddd|0 dd dddd dddd|+966 dd ddd dddd|0dd ddd dddd|+66 dd ddd dddd|0dd-ddd-dddd|Ddddddddd"
IDS = "ddd-dd-dddd|ddd dd dddd|ddddddddd|Ldd dd dddd|dddddddd-L|ddddddddL|d dd dd dd ddd ddd dd|ddddddddddddddd|dd ddd ddd ddd|ddddddddddd|LLddddddL|ddd.ddd.ddd-dd|dd.ddd.ddd-d|dd dd № dddddd|dddd номер dddddd|dddd dddddd|ddd-ddd-ddd dd|dddddddddddddddddd|dddddddddddddddddL|LLddddddd|LLdddddddd|Lddddddddd|dddd dddd dddd|Ldddddddd|dddddddddd|d-dddd-ddddd-dd-d|LLLLLddddL"
ORDERS = "ddd-ddd-dddd|ddd-dddd-dddd|dddd-dddd-dddd|dddd-ddd-dd|dd-dddd-ddd|dddd-dd-dd|ddd-dd-dddd|dd-dd-ddd|dddd-dddd|dddd-ddd|dd-ddd-dddd|dddddd|ddddddd|LL-dddd|LLdddd|LLL-ddd-ddd|ddd-ddddddd|d-dd-d|dd-d-dd"


class Values:
    """Made-up values of each type in many spellings."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def pattern(self, forms: str) -> str:
        return re.sub("[dDL]", lambda m: self.r.choice("ABCDEFGHKLMNPRSTVXYZ") if m.group() == "L" else str(self.r.randint(0 if m.group() == "d" else 1, 9)), self.r.choice(forms.split("|")))

    def rare(self, n: int) -> str:
        """Any Han characters."""
        return "".join(chr(self.r.randint(0x4E00, 0x9FA5)) for _ in range(n))

    def coined(self) -> str:
        if self.r.random() < 0.4:
            return "".join(self.r.choice("bcdfghjklmnprstvwz") + self.r.choice(("a", "e", "i", "o", "u", "ou", "er", "in", "al", "or")) for _ in range(self.r.choice((2, 3)))).capitalize()
        return "".join(self.r.sample(_SYLLABLES, self.r.choice((2, 2, 3)))).capitalize()

    def phone(self, lang: str) -> str:
        if self.r.random() < 0.1 and lang in ("en", "es", "de", "fr", "pt"):
            words = lex.DIGIT_WORDS[:11] if lang == "en" else lex.DIGIT_WORDS[12:22] if lang == "es" else lex.DIGIT_WORDS[22:32] if lang == "de" else lex.DIGIT_WORDS[32:41] if lang == "fr" else lex.DIGIT_WORDS[41:48]
            groups = self.r.choice(((3, 4), (3, 3, 4), (4, 3), (8,), (2, 2, 2, 2), (1,) * 8))
            return ", ".join(" ".join(self.r.choice(words) for _ in range(k)) for k in groups)
        return self.pattern(PHONES)

    def id_number(self, lang: str) -> str:
        return self.pattern(IDS)

    def email(self, lang: str) -> str:
        r = self.r
        user = r.choice(("jo", "k.val", "m_ra", "bo-w", "tess", "nn", self.coined().lower())) + r.choice(("", ".", "_", "-")) + self.coined().lower()[:6] + r.choice(("", str(r.randint(1, 999)), "+news"))
        host = r.choice(("example.net", "mail.example", "inbox.test", "home.example.com", "post.example.org", self.coined().lower() + ".com", "mail." + self.coined().lower() + ".de"))
        form = r.randrange(10)
        if form < 5:
            return f"{user}@{host}"
        if form == 5:
            return f"{user}@{host}".upper()
        if form == 6:
            return f"{user}{r.choice(('(at)', ' (at) ', '[at]', ' [at] '))}{host}"
        if form == 7:
            return f"{user} at {host.replace('.', ' dot ')}"
        return f"{user} [at] {host.replace('.', ' [dot] ')}" if form == 8 else f"{user} (at) {host.replace('.', ' (dot) ')}"

    def name(self, lang: str) -> str:
        r = self.r
        if lang == "ru":
            g = r.choice(lex.GIVEN_CYRILLIC).capitalize()
            s = ("".join(r.sample(_CYRILLIC, r.choice((1, 2)))) + r.choice("ников ский арин аев ожкин ова ина свет енко ин ов макова".split())).capitalize()
            return r.choice((f"{g} {s}", f"{g} {s}", f"{g[0]}. {s}", f"{s}, {g}", f"{s} {g}", f"{g} {s}".lower(), f"{r.choice(('г-жа', 'г-н', 'господин', 'госпожа'))} {s}", g))
        if lang == "zh":
            return (r.choice(lex.SURNAMES_HAN) if r.random() < 0.7 else r.choice(lex.SURNAMES_HAN_LONG)) + ("".join(r.sample(lex.GIVEN_HAN, r.choice((1, 2, 2)))) if r.random() < 0.7 else self.rare(r.choice((1, 2, 2))))
        if lang == "ja":
            s = r.choice(lex.SURNAMES_JA) if r.random() < 0.4 else self.rare(r.choice((2, 3))) if r.random() < 0.4 else "".join(r.sample("霧月桐氷星雪花森野川原宮瀬島崎沢谷井ノヶ", r.choice((2, 3))))
            return s + r.choice(("", "", " ")) + (r.choice(lex.GIVEN_JA) if r.random() < 0.7 else "".join(r.sample(_KANA, r.choice((2, 3)))))
        if lang == "hi":
            g, s = r.choice(lex.GIVEN_DEVANAGARI), "".join(r.sample(_DEVANAGARI, 2))
            return r.choice((f"{g} {s}", f"{g} {s}", f"{s}, {g}", f"{r.choice(('श्री', 'श्रीमती', 'डॉ.'))} {s}", f"{g[0]}. {s}"))
        if lang == "ar":
            g, s = r.choice(lex.GIVEN_ARABIC), r.choice(_ARABIC)
            return r.choice((f"{g} {s}", f"{g} {s}", f"{r.choice(('السيد', 'السيدة', 'الدكتور'))} {s}", f"{g} {r.choice(lex.GIVEN_ARABIC)} {s}"))
        if lang == "th":
            g, s = r.choice(lex.GIVEN_THAI), "".join(r.sample(_THAI, 2))
            return r.choice(("", "", "นาย", "นางสาว", "คุณ")) + f"{g} {s}"
        g, s = r.choice(lex.GIVEN_LATIN).capitalize(), self.coined()
        g2 = r.choice(lex.GIVEN_LATIN).capitalize()
        titles = {"en": "Mr. Mrs. Ms. Dr. Prof.", "es": "Sr. Sra. Dr. Don Doña", "fr": "M. Mme Mlle Dr", "de": "Herr Frau Dr. Prof.", "pt": "Sr. Sra. Dr. Dra."}[lang].split()
        forms = (f"{g} {s}", f"{g} {s}", f"{g} {s}", f"{g} {s}".lower(), f"{s}, {g}", f"{g[0]}. {s}", f"{r.choice(titles)} {s}", f"{r.choice(titles)} {g} {s}", f"{g} {g2} {s}", f"{g} {r.choice(('de', 'van', 'von', 'da', 'del'))} {s}", f"{self.coined()} {s}", f"{g} {s}-{self.coined()}", g)
        return r.choice(forms)

    def address(self, lang: str) -> str:
        r, d, c, city = self.r, self.pattern, self.coined(), self.coined()
        n, k = r.randint(1, 240), r.randint(1, 60)
        if lang == "en":
            last = r.choice("Street Avenue Lane Road Terrace Court Drive Close Square St. Rd. Ave. Ln. Ct Way Crescent".split())
            return r.choice((f"{n} {c} {last}, {city}", f"{n} {c} {last}", f"Apt. {k}, {n} {c} {last}, {city}", f"Flat {k}, {n} {c} {last}, Port {city} {d('ddddd')}", f"{n}{r.choice('ab')} {c} {city} {last}, {city}", f"{n} {c} {last}, Apt {k}, {city}, {d('ddddd')}"))
        if lang == "es":
            return r.choice(("calle", "avenida", "plaza", "paseo", "Calle", "C/", "Av.")) + r.choice((f" {c}, {n}, {city}", f" del {c} Viejo, {n}, {k % 9 + 1}.º {r.choice('ABC')}, {city}", f" de {c}, {n}", f" {c} {n}, {d('ddddd')} {city}", f" {c}, n.º {n}, {city}"))
        if lang == "fr":
            way = r.choice(("rue", "avenue", "boulevard", "chemin", "impasse", "allée"))
            return r.choice((f"{n}, {way} {c}, {d('ddddd')} {city}", f"{n} {way} de la {c}, {d('ddddd')} Saint-{city}", f"{n} bis, {way} des {c}", f"{n} {way} du {c}, {city}"))
        if lang == "de":
            way = r.choice(("straße", "strasse", "weg", "gasse", "platz", "allee", "str."))
            return r.choice((f"{c}{way} {n}, {d('ddddd')} {city}", f"{c}{way} {n}", f"{c}{way} {n}{r.choice('abc')}, {d('ddddd')} Bad {city}", f"Am {c} {n}, {d('ddddd')} {city}"))
        if lang == "pt":
            return r.choice(("rua", "avenida", "travessa", "praça", "alameda", "Rua", "Av.")) + r.choice((f" {c}, {n}, {city}", f" das {c}, n.º {n}, {city}", f" {c}, {n}, apto {k}, {city}", f" {c}, {n}"))
        if lang == "ru":
            s = "".join(r.sample(_CYRILLIC, 2)).capitalize() + r.choice(("ская", "ная", "овая"))
            town = "".join(r.sample(_CYRILLIC, 2)).capitalize() + r.choice(("ск", "град", "горск"))
            return r.choice((f"ул. {s}, д. {n}, кв. {k}", f"г. {town}, ул. {s}, д. {n}, кв. {k}", f"ул. {s}, д. {n}, г. {town}", f"улица {s}, дом {n}", f"проспект {s}, {n}"))
        if lang == "zh":
            p = lambda m: "".join(r.sample(_HAN_PLACES, m))
            return r.choice((f"{p(2)}市{p(2)}路{n}号{k}室", f"{p(2)}市{p(2)}区{p(3)}街{n}号", f"{p(2)}路{n}号", f"{p(2)}省{p(2)}市{p(2)}巷{n}号{k}楼"))
        if lang == "ja":
            p = lambda m: "".join(r.sample("桜水風花月森川山田野原木松竹梅", m))
            return r.choice((f"{p(2)}市{p(2)}町{n % 9 + 1}-{k}-{n}", f"{p(2)}県{p(2)}市{p(2)}{n % 9 + 1}丁目{k}番地", f"{p(2)}区{p(2)}{n % 9 + 1}-{k}"))
        if lang == "hi":
            s, t = ("".join(r.sample(_DEVANAGARI, 2)) for _ in range(2))
            return r.choice((f"मकान {n}, {s} {r.choice(('चौक', 'गली', 'मार्ग', 'नगर'))}, {t}", f"मकान नं. {n}, {s} सड़क, {t}", f"{n}, {s} कॉलोनी, {t}"))
        if lang == "ar":
            s = r.choice(_ARABIC)
            return r.choice((f"شارع {s} رقم {n}", f"شارع {s} {n}، حي {r.choice(_ARABIC)}", f"حي {s}، شارع {k}، مبنى {n}", f"{n} شارع {s}"))
        s = "".join(r.sample(_THAI, 2))
        return r.choice((f"บ้านเลขที่ {n} ถนน{s}", f"{n}/{k} หมู่ {k % 9 + 1} ตำบล{s}", f"{n} ซอย{s} เขต{''.join(r.sample(_THAI, 2))}", f"เลขที่ {n} ถนน{s} จังหวัด{''.join(r.sample(_THAI, 2))}"))

    def amount(self) -> str:
        return self.r.choice((str(self.r.randint(1, 99999)), f"{self.r.randint(1, 99)}.{self.r.randint(0, 99)}", f"{self.r.randint(1, 99)},{self.r.randint(0, 9)}", f"{self.r.randint(1, 9)},{self.pattern('ddd')}"))

    def technical(self) -> str:
        r = self.r
        return r.choice((f"10.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}", f"192.168.{r.randint(0, 9)}.{r.randint(1, 250)}", f"{r.randint(0, 30)}.{r.randint(0, 99)}.{r.randint(0, 9)}", f"{r.randint(0, 9)}.{r.randint(0, 9999)}.{r.randint(0, 9)}", f"20{r.randint(10, 30)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{r.randint(1, 12)}:{r.randint(10, 59)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.20{r.randint(10, 30)}", f"https://{self.coined().lower()}.example/{r.randint(1, 99)}", f"v{r.randint(1, 9)}.{r.randint(0, 9)}"))


def generated(n: int = 9000, seed: int = 11) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with the spans that are personal information; about two in five have none."""
    v = Values(seed)
    r = v.r
    langs = list(CARRIERS)
    for _ in range(n):
        text, spans = "", []
        lang = r.choice(("en", *langs))
        solid = lang in ("zh", "ja")
        for _ in range(r.choice((1, 1, 2, 3))):
            kind = r.choice(("name", "name", "name", "phone", "phone", "id_number", "id_number", "address", "address", "email", None, None, None, None, None, None, "line"))
            if kind == "line":
                parts = [(v.name(lang), "name"), (v.address(lang), "address"), (r.choice(("tel. ", "", "")), None), (v.phone(lang), "phone")]
                pattern = "{v}, {v}, {v}{v}"
            else:
                pattern = r.choice((PLAIN[lang] if kind is None else CARRIERS[lang][kind]).split("|"))
                parts = None
            begin = text
            for piece in re.split(r"(\{\w\})", pattern):
                if piece == "{v}":
                    value, k = parts.pop(0) if parts else (getattr(v, kind)(lang), kind)
                    if k:
                        spans.append((len(text), len(text) + len(value), k))
                    text += value
                elif piece == "{c}":
                    text += v.coined() + (r.choice((" Ltd.", " GmbH", " Inc.", " Corp.")) if r.random() < 0.1 else "")
                elif piece in ("{o}", "{q}", "{w}"):
                    text += {"{o}": lambda: v.pattern(ORDERS), "{q}": v.amount, "{w}": v.technical}[piece]()
                elif piece:
                    text += piece[:1].upper() + piece[1:] if text == begin and not solid and r.random() < 0.85 else piece
            text += ("。" if solid else "।" if lang == "hi" else " " if lang == "th" else r.choice((".", ".", ".", "!", "?", ",", ""))) + ("" if solid else " ")
        text = text.rstrip(" ,")
        if r.random() < 0.5:
            text = text.replace("'", "’")
        form = r.random()
        if form < 0.06 and len(text.lower()) == len(text):
            text = text.lower()
        elif form < 0.1 and len(text.upper()) == len(text):
            text = text.upper()
        yield text, [s for s in spans if s[1] <= len(text)]
