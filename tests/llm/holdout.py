"""Labelled texts that no seed and no table holds, to measure recall and precision on: by language and class, and natural ones that come near."""

TEXTS = {
    "en": {
        "placeholder": [
            "Dear $recipient, thank you for the lovely parcel.", "The [[widget:caption]] arrived on time.", "Hello !!FIRSTNAME!!, I liked the shoes.", "We stayed at {{hotel.name}} for three nights.", "My ${device} stopped charging after a week.", "I gave %%VENDOR%% five stars.", "As {{ user.nickname | capitalize }} said, the fabric is thin.", "I bought it for [SPOUSE NAME] last spring.",
            "The <%= model.number %> has a bright screen.", "Best regards, @@SIGNATURE@@", "Order #{order.reference} came with scratches.", "The {COLOR_NAME} one looks nicer in real life.", "Rated by *|MERGE_LNAME|* in March.", "[insert your opinion here]", "I think that {0} should be cheaper than {1}.", "The blender from <INSERT STORE> is loud.", "Name: __________ Comment: __________", "Thanks to {%owner%} for the quick reply.", "Received ##QTY## units of the lamp.", "This is what I wrote about [product].",
        ],
        "filler": [
            "poiuytrewq poiuytrewq", "Lorem ipsum dolor sit amet, vivamus porta nisl.", "Donec id elit non mi porta gravida at eget metus.", "asdkjh asdkjh asdkjh qwepoi", "This is just placeholder copy until the final version arrives.", "dummy dummy dummy", "Testing 123 testing 123", "Sample description. Sample description.", "Type something here to get started", "Just testing the form, please ignore.", "Nulla vitae elit libero, a pharetra augue.", "test test", "xcvbnm xcvbnm xcvbnm", "Placeholder paragraph for the design.", "blah blah blah", "This is a dummy review for testing purposes.", "Cras mattis consectetur purus sit amet fermentum.", "Insert text. Sample text. Sample text.", "foo bar baz foo bar", "Lorem ipsum lorem ipsum lorem ipsum",
        ],
        "notice": [
            "HTTP ERROR 500 This page isn't working right now.", "We've detected unusual traffic from your network.", "This content isn't available in your region.", "404. That's an error. The requested URL was not found on this server.", "JavaScript is not enabled in your browser. Turn it on and reload the page.", "Access to this page has been denied because we believe you are using automation tools.", "Sorry, you have been rate limited. Try again later.", "The page you were looking for doesn't exist.", "You need to sign in before you can see this page.", "Our site is undergoing scheduled maintenance. We should be back shortly.",
            "502 Bad Gateway openresty", "Please complete the security check to continue.", "Error: connection to database failed.", "Oops! Something went wrong while loading this page.", "Your session has timed out. Log in again.", "Please wait while we verify your browser...", "Cookies must be enabled to use this website.", "Internal Server Error. The server encountered an unexpected condition.", "Exception in thread \"main\" java.lang.IllegalStateException", "This site can't provide a secure connection. ERR_SSL_PROTOCOL_ERROR",
        ],
        "natural": [
            "The template for cutting the shelf was included, which saved me an hour.", "My son tests everything: he dropped it twice and it still works.", "The router shows error 404 on its page until you update it.", "Great sound (much better than my old one) for the price.", "It's the sample size, not the full bottle, so check the title.", "I had to enable scripts in the settings menu before the printer worked.", "Access to the battery is easy, two screws and you are in.", "The server at the shop was friendly.", "I left the name field on the label blank on purpose.", "The book has dummy pages at the end for notes.", "Use code SAVE10 for 10% off, I paid $35.", "Works with <b>both</b> plugs; 5/5!", "My grandmother, nan to us, loves it.", "The text on the back is tiny [see photo].", "It was not found in the box, so I wrote to them.",
        ],
    },
    "de": {
        "placeholder": [
            "Sehr geehrte/r {{anrede}} {{nachname}}, danke für den Schal.", "Ich habe das Gerät bei %HAENDLER% gekauft.", "Der ${farbe} Rucksack sitzt gut.", "[Hier Ihren Namen einfügen] war zufrieden.", "Hallo [VORNAME], die Lampe ist hell.", "Der <%= artikel %> kam nach zwei Tagen.", "Bestellung ##AUFTRAG## war vollständig.", "Meine Meinung zu [Produkt eintragen]: top.", "Danke an $kundenname für die Hilfe.", "Die Tasche von {marke} ist schwer.", "Preis: ________ Euro", "Ich gebe [[sterne]] von fünf.",
        ],
        "filler": [
            "Dies ist nur ein Blindtext.", "Beispieltext Beispieltext Beispieltext", "test test test", "asdfg asdfg asdfg", "Hier kommt später der richtige Text hin.", "Lorem ipsum dolor sit amet.", "Das ist ein Testeintrag.", "Platzhaltertext für das Layout.", "bla bla bla bla", "Mustertext, bitte ersetzen.", "Nur ein Test, bitte löschen.", "wertzuiop wertzuiop",
        ],
        "notice": [
            "Diese Seite wurde leider nicht gefunden.", "Bitte schalten Sie JavaScript in Ihrem Browser ein.", "Der Zugriff auf diese Seite wurde verweigert.", "Fehler 500: Interner Serverfehler", "Ihre Sitzung ist leider abgelaufen. Bitte neu anmelden.", "Die Seite wird zurzeit gewartet. Bitte versuchen Sie es später.", "Der Server antwortet nicht.", "Bitte bestätigen Sie, dass Sie ein Mensch und kein Roboter sind.", "Dieser Inhalt ist in Ihrem Land nicht verfügbar.", "Ein unbekannter Fehler ist aufgetreten.", "JavaScript muss aktiviert sein.", "Zu viele Anfragen, bitte warten Sie einen Moment.",
        ],
        "natural": [
            "Der Test in der Küche verlief gut, die Pfanne klebt nicht.", "Die Seite des Buches war geknickt.", "Das Muster (blau) gefällt mir sehr.", "Beim Zugriff auf das Fach klemmt der Deckel.", "Mein Name steht jetzt auf dem Schild, sieht klasse aus.", "Der Fehler lag bei mir, falsch montiert.", "Wartung ist kaum nötig, einmal im Jahr ölen.", "Der Text auf der Rückseite ist gut lesbar.", "Genau richtig für zwei Personen.", "Die Anleitung erklärt JavaScript Schritt für Schritt.",
        ],
    },
    "fr": {
        "placeholder": [
            "Bonjour {{ client.prenom }}, la lampe est jolie.", "J'ai reçu mon ${article} hier.", "Merci à [VOTRE NOM] pour le conseil.", "Le sac %COULEUR% est solide.", "Mon avis sur [insérer le produit] : parfait.", "Cher $destinataire, tout va bien.", "La commande ##NUMERO## est arrivée.", "Acheté chez {magasin} en mars.", "Nom : __________", "Je donne [[note]] étoiles.", "Le <%= produit %> chauffe vite.", "Produit : [à compléter]",
        ],
        "filler": [
            "Ceci est un texte d'exemple.", "Texte à remplacer plus tard.", "test test test", "azerty azerty azerty", "Lorem ipsum dolor sit amet.", "Faux texte pour la maquette.", "bla bla bla", "Ceci est juste un test.", "Votre texte sera ici.", "Contenu de test, merci d'ignorer.", "Texte provisoire texte provisoire", "qsdf qsdf qsdf",
        ],
        "notice": [
            "Cette page est introuvable.", "JavaScript doit être activé pour afficher cette page.", "Vous n'avez pas accès à cette page.", "Erreur 500 : erreur interne du serveur", "Session expirée, veuillez vous reconnecter.", "Le site est actuellement en maintenance.", "Le serveur ne répond pas.", "Veuillez confirmer que vous êtes un humain.", "Ce contenu n'est pas disponible dans votre pays.", "Une erreur inconnue est survenue.", "Activez les cookies dans votre navigateur pour continuer.", "Trop de tentatives, réessayez plus tard.",
        ],
        "natural": [
            "Le test en cuisine s'est bien passé.", "La page du livre était pliée.", "Le modèle (bleu) me plaît beaucoup.", "L'accès à la batterie est facile.", "Mon nom est gravé dessus, très joli.", "L'erreur venait de moi, mal monté.", "Peu d'entretien, une goutte d'huile par an.", "Le texte au dos est lisible.", "Mon fils a essayé deux fois et ça marche.", "Le livre explique JavaScript pas à pas.",
        ],
    },
    "es": {
        "placeholder": [
            "Hola {{ cliente.nombre }}, la lámpara es bonita.", "Recibí mi ${articulo} ayer.", "Gracias a [SU NOMBRE] por el consejo.", "El bolso %COLOR% es fuerte.", "Mi opinión sobre [inserte el producto aquí]: perfecto.", "Estimado $destinatario, todo bien.", "El pedido ##NUMERO## llegó.", "Comprado en {tienda} en marzo.", "Nombre: __________", "Le doy [[puntos]] estrellas.", "El <%= producto %> calienta rápido.", "Producto: [por completar]",
        ],
        "filler": [
            "Este es un texto de ejemplo.", "Texto que se cambiará más tarde.", "prueba prueba prueba", "qwerty qwerty qwerty", "Lorem ipsum dolor sit amet.", "Texto de relleno para el diseño.", "bla bla bla", "Esto es solo una prueba.", "Su texto irá aquí.", "Contenido de prueba, por favor ignorar.", "Texto de muestra texto de muestra", "asdf asdf asdf",
        ],
        "notice": [
            "No se encontró esta página.", "JavaScript debe estar activado para ver esta página.", "No tiene acceso a esta página.", "Error 500: error interno del servidor", "Sesión caducada, vuelva a iniciar sesión.", "El sitio está actualmente en mantenimiento.", "El servidor no responde.", "Por favor confirme que es una persona y no un robot.", "Este contenido no está disponible en su país.", "Se produjo un error desconocido.", "Active las cookies en su navegador para continuar.", "Demasiados intentos, inténtelo más tarde.",
        ],
        "natural": [
            "La prueba en la cocina salió bien.", "La página del libro estaba doblada.", "El modelo (azul) me gusta mucho.", "El acceso a la batería es fácil.", "Mi nombre va grabado, muy bonito.", "El error fue mío, lo monté mal.", "Poco mantenimiento, una gota de aceite al año.", "El texto de atrás se lee bien.", "Mi hijo lo probó dos veces y funciona.", "El libro explica JavaScript paso a paso.",
        ],
    },
    "ru": {
        "placeholder": [
            "Здравствуйте, {{ клиент.имя }}, лампа красивая.", "Получил свой ${товар} вчера.", "Спасибо [ВАШЕ ИМЯ] за совет.", "Сумка %ЦВЕТ% крепкая.", "Мой отзыв о [вставьте название]: отлично.", "Уважаемый $получатель, всё хорошо.", "Заказ ##НОМЕР## пришёл.", "Куплено в {магазин} в марте.", "Имя: __________", "Ставлю [[оценка]] звёзд.", "Чайник <%= модель %> греет быстро.", "Товар: [заполнить]",
        ],
        "filler": [
            "Это пример текста.", "Текст будет заменён позже.", "тест тест тест", "йцукен йцукен йцукен", "Lorem ipsum dolor sit amet.", "Рыбный текст для макета.", "бла бла бла", "Это просто проверка.", "Здесь будет ваш текст.", "Тестовая запись, не обращайте внимания.", "Текст-заглушка текст-заглушка", "фыва фыва фыва",
        ],
        "notice": [
            "Страница не найдена.", "Для просмотра страницы необходимо включить JavaScript.", "У вас нет доступа к этой странице.", "Ошибка 500: внутренняя ошибка сервера", "Сессия истекла, войдите заново.", "Сайт находится на техническом обслуживании.", "Сервер не отвечает.", "Пожалуйста, подтвердите, что вы человек.", "Этот контент недоступен в вашей стране.", "Произошла неизвестная ошибка.", "Включите файлы cookie в браузере, чтобы продолжить.", "Слишком много попыток, попробуйте позже.",
        ],
        "natural": [
            "Проверка на кухне прошла хорошо.", "Страница в книге была помята.", "Модель (синяя) очень нравится.", "Доступ к батарее простой.", "Моё имя выгравировано, красиво.", "Ошибка была моя, собрал неправильно.", "Ухода почти не требует, раз в год смазать.", "Текст на обороте читается хорошо.", "Сын попробовал два раза, работает.", "Книга объясняет JavaScript шаг за шагом.",
        ],
    },
    "ja": {
        "placeholder": [
            "{{お客様.名前}}様、ランプはきれいです。", "昨日${商品}を受け取りました。", "[お名前]様のおかげです。", "【商品名を入力】は丈夫です。", "〇〇様、ありがとうございます。", "注文##番号##が届きました。", "{店舗}で三月に買いました。", "氏名：__________", "[[評価]]つ星です。", "<%= 型番 %>はすぐ温まります。", "（ここに商品名を入力）のレビュー", "%色%のかばんは軽いです。",
        ],
        "filler": [
            "これはサンプルテキストです。", "ダミーテキストです。", "テスト テスト テスト", "あああああ", "Lorem ipsum dolor sit amet.", "レイアウト用のダミー文章です。", "これはただのテストです。", "ここにテキストが入ります。", "テスト投稿です。無視してください。", "サンプル サンプル サンプル", "ダミー ダミー ダミー", "テストテスト",
        ],
        "notice": [
            "ページが見つかりませんでした。", "JavaScriptを有効にしてから再度お試しください。", "このページへのアクセス権がありません。", "500 内部サーバーエラー", "セッションが切れました。もう一度ログインしてください。", "現在メンテナンス中です。", "サーバーが応答しません。", "あなたが人間であることを確認してください。", "このコンテンツはお住まいの地域では利用できません。", "不明なエラーが発生しました。", "Cookieを有効にしてください。", "アクセスが集中しています。しばらくお待ちください。",
        ],
        "natural": [
            "台所で試したところ、とても良かったです。", "本のページが折れていました。", "青い方（大きいサイズ）が気に入りました。", "電池の交換は簡単です。", "名前を彫ってもらいました、素敵です。", "私の組み立てミスでした。", "手入れはほとんど要りません。", "裏の文字も読みやすいです。", "息子が二回試しましたが動きます。", "この本はJavaScriptを順に説明しています。",
        ],
    },
}
