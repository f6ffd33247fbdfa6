"""Word lists that the span field uses as features and its training texts as values: fixed values, from general knowledge."""

from __future__ import annotations

GIVEN_LATIN = """james john robert michael william david richard joseph thomas charles daniel matthew anthony mark donald steven paul andrew joshua kevin brian george edward ronald timothy jason jeffrey
ryan jacob gary nicholas eric jonathan stephen larry justin scott brandon benjamin samuel gregory frank alexander raymond patrick jack dennis jerry tyler aaron henry adam peter nathan oliver harry
mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa betty margaret sandra ashley emily donna michelle carol amanda dorothy melissa deborah stephanie rebecca laura helen
sharon cynthia kathleen amy angela anna brenda pamela emma nicole samantha katherine christine rachel olivia grace alice hannah sophie amelia charlotte lucy julia chloe ella
javier diego carlos josé juan luis miguel pablo jorge pedro manuel antonio francisco fernando sergio alberto raúl andrés marta lucía maría carmen elena sofía paula ana isabel pilar rosa teresa cristina silvia
jean pierre luc philippe michel alain nicolas laurent antoine hugo louis camille marie julie claire chloé léa sophie isabelle nathalie sylvie céline manon inès julien mathieu guillaume sébastien françois christophe stéphane olivier vincent aurélie émilie élodie caroline pauline valérie véronique sandrine hélène
hans lukas jürgen klaus felix jonas stefan wolfgang dieter uwe matthias tobias lena anna sabine mia greta katrin heike monika ursula petra claudia birgit anja
joão tiago rui paulo ricardo rafael gustavo felipe bruno mariana beatriz inês luísa fernanda camila larissa juliana gabriela adriana""".split()
GIVEN_CYRILLIC = "иван павел дмитрий сергей алексей николай пётр андрей михаил владимир александр игорь олег виктор юрий максим артём марина ольга анна елена наталья мария татьяна юлия светлана ирина екатерина галина людмила вера оксана".split()
GIVEN_DEVANAGARI = "अमित प्रिया सुनीता राहुल अनिल सुरेश कविता नेहा विजय राजेश पूजा संजय मनोज दीपक रवि किरण अंजलि मीना सीमा आशा गीता रेखा विनोद अजय राकेश मोहन सोनिया निशा रोहित विकास".split()
GIVEN_ARABIC = "محمد أحمد علي حسن حسين خالد عمر يوسف إبراهيم محمود سعيد فاطمة مريم عائشة زينب سارة ليلى نور هدى سلمى رامي طارق كريم ياسر سامي منى رنا دينا هند".split()
GIVEN_THAI = "สมชาย สมหญิง สุชาติ วิชัย มานี มานะ ปรีชา นภา อรุณ กมล สุดา พิมพ์ใจ ณัฐ ธนา วรรณา ชัยวัฒน์ ประเสริฐ สุภาพร รัตนา อนงค์".split()
SURNAMES_HAN = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
SURNAMES_HAN_LONG = "欧阳 司马 上官 诸葛 东方 慕容 令狐 皇甫 司徒 端木 南宫 夏侯".split()
GIVEN_HAN = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华玉萍红建文辉力鹏飞晓雪梅婷佳欣怡子涵宇轩浩然思琪雨晨嘉俊"
SURNAMES_JA = "佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 吉田 山田 佐々木 山口 松本 井上 木村 林 清水 山崎 森 池田 橋本 阿部 石川 山下 中島 石井 小川 前田 岡田 長谷川 藤田 後藤 近藤 村上 遠藤 青木 坂本 斉藤 福田 太田 西村 藤井 金子 岡本 藤原 三浦 中野 原田".split()
GIVEN_JA = "太郎 花子 健太 由美 陽子 一郎 次郎 美咲 翔太 大輔 直樹 恵子 久美子 裕子 さくら はるか ひろし たかし けんじ あゆみ まさる ゆうこ あきら みどり なおみ".split()
TITLES = "mr mrs ms miss mx dr prof sir sr sra srta don doña dra herr frau hr fr mme mlle m monsieur madame mademoiselle senhor senhora г-жа г-н господин госпожа श्री श्रीमती सुश्री डॉ السيد السيدة الدكتور الدكتورة الأستاذ นาย นาง นางสาว คุณ".split()
STREETS = """street st avenue ave road rd lane ln court ct terrace drive dr way close crescent boulevard blvd square row place alley apartment apt flat unit suite floor
calle avenida av avda plaza paseo camino carretera piso puerta rua travessa praça alameda estrada bairro apto rue avenue chemin impasse quai allée place cours étage appartement
straße strasse str weg gasse platz allee damm ring ufer hof улица ул проспект пр пр-т переулок пер набережная наб шоссе площадь дом д квартира кв корпус г город
路 街 巷 道 里 弄 号 室 楼 栋 市 区 县 省 镇 村 丁 目 番 地 町 郡 府 मकान गली सड़क मार्ग चौक नगर मोहल्ला कॉलोनी شارع طريق حي مبنى بناية عمارة شقة รหัส ถนน ซอย หมู่ บ้าน ตำบล อำเภอ จังหวัด แขวง เขต""".split()
LEGAL = "inc ltd corp llc gmbh ag sa kg co plc ltda cia bv spa srl oy ab group team shop store app".split()
MONTHS = "january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec monday tuesday wednesday thursday friday saturday sunday januar februar märz april mai juni juli oktober dezember enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre janvier février mars avril mai juin juillet août septembre octobre novembre décembre janeiro fevereiro março maio junho julho setembro outubro novembro dezembro января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()
DIGIT_WORDS = "zero oh one two three four five six seven eight nine double cero uno dos tres cuatro cinco seis siete ocho nueve null eins zwei drei vier fünf sechs sieben acht neun zéro un deux trois quatre cinq sept huit neuf um dois três quatro sete oito nove ноль один два три четыре пять шесть семь восемь девять".split()
AT_WORDS = "at arroba arobase собака".split()

GIVEN = frozenset((*GIVEN_LATIN, *GIVEN_CYRILLIC, *GIVEN_DEVANAGARI, *GIVEN_ARABIC, *GIVEN_THAI))
SETS = {"given": GIVEN, "title": frozenset(TITLES), "street": frozenset(STREETS), "legal": frozenset(LEGAL), "month": frozenset(MONTHS), "digit": frozenset(DIGIT_WORDS), "at": frozenset(AT_WORDS), "family": frozenset(SURNAMES_HAN)}
#: Names of the sets that hold a word.
FLAGS: dict[str, tuple[str, ...]] = {}
for _name, _words in SETS.items():
    for _word in _words:
        FLAGS[_word] = (*FLAGS.get(_word, ()), _name)
