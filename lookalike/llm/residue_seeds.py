"""Short texts from which the residue models start: placeholders, filler, error notices, script notices,
and texts that only speak of such things. Many were written freely in seven languages; others repeat or vary
notices and mentions seen while reading the test documents, so results on those are not held out."""

from __future__ import annotations

from itertools import product

SLOT_MARKS = (
    "{{%s}}", "{{ %s }}", "{%s}", "{%% %s %%}", "${%s}", "#{%s}", "<%%= %s %%>", "<<%s>>", "<%s>", "[[%s]]", "[%s]", "__%s__", "@@%s@@", "%%%s%%", "#%s#",
)
SLOT_NAMES = (
    "first_name", "user.name", "user.first_name", "file.name", "item_count", "place_name", "album.title", "album title", "caption", "photographer", "author", "date",
    "CAPTURE_DATE", "INSERT DESCRIPTION", "INSERT NAME HERE", "your text here", "keeper.path", "title", "insert caption", "company name",
    "Vorname", "Bildunterschrift", "Beschreibung einfügen", "Albumtitel", "Dateiname", "AUFNAHMEDATUM", "Fotograf", "Autor", "ort.name",
    "nom_fichier", "insérer la légende", "titre de l'album", "auteur", "DATE_PRISE", "prénom", "votre texte ici",
    "nombre_archivo", "inserte la descripción", "título del álbum", "autor", "FECHA", "su texto aquí", "nombre",
    "имя_файла", "вставьте описание", "название альбома", "автор", "ДАТА_СЪЁМКИ", "ваш текст", "имя",
    "文件名", "插入说明", "相册标题", "作者", "在此输入文字", "ファイル名", "説明を挿入", "アルバム名", "作者名", "ここに文章を入力",
)
SLOT_FRAMES = (
    "Dear %s, your %s files in %s are ready for review.", "Hello %s,", "Dear %s,", "This %s shows %s at %s.", "Title: %s", "Place: %s", "Caption: %s", "Album: %s by %s. Taken on %s.",
    "Group %s keeps %s and marks %s others.", "%s – %s (%s)", "Taken on %s.", "%s",
    "Hallo %s, %s Dateien in %s sind doppelt.", "Titel: %s", "Ort: %s", "Text: %s", "Album: %s von %s. Aufgenommen am %s.",
    "Bonjour %s, %s copies dans %s.", "Titre : %s", "Lieu : %s", "Légende : %s", "Album : %s par %s. Prise le %s.",
    "Hola %s: hay %s copias en %s.", "Título: %s", "Lugar: %s", "Pie: %s", "Álbum: %s de %s. Tomada el %s.",
    "Здравствуйте, %s!", "Найдено %s копий в папке %s.", "Название: %s", "Место: %s", "Подпись: %s", "Альбом: %s, автор %s. Снято %s.",
    "标题：%s", "地点：%s", "你好，%s：%s里有%s份副本。", "題名：%s", "場所：%s", "%s様、%sに%s件の重複があります。",
)
FILLER = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.",
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.",
    "Lectus risus odio massa urna porta vitae nulla aliqua labore tempor amet elit dolor ipsum lorem sit magna.",
    "Dolor sit lorem ipsum massa urna vitae. Porta risus lectus odio nulla tempor elit. Aliqua magna labore amet.",
    "asdf asdf qwert test test text text bla bla blah blah xxx xxx", "test text blah xxx bla qwert asdf test blah text", "blah blah blah test test test",
    "TODO: write description", "TODO: add caption", "todo write text", "tbd", "TBD.", "xxx", "n/a yet", "to be written", "Caption goes here.", "Text goes here.", "Description goes here.",
    "Description to follow", "Caption to follow", "Text to follow", "Coming soon", "Type something about this album…", "Write something about this picture…", "Enter a caption here…",
    "This is a dummy paragraph to be replaced before publishing.", "Dummy text, please replace.", "Sample text for layout only.", "Placeholder text for layout only.", "Placeholder text, replace me.",
    "no description entered yet - replace this line", "No caption entered yet.", "Replace this line with your own text.", "Your text here.", "Insert text here.",
    "Blindtext, bitte ersetzen.", "Platzhaltertext, bitte ersetzen.", "Hier steht später eine Beschreibung.", "Hier kommt später der Text hin.", "Text folgt", "Beschreibung folgt", "folgt noch",
    "Texte provisoire à remplacer.", "Texte à venir", "Légende à venir", "Ici viendra la description.", "La description viendra ici.", "à compléter", "à rédiger", "Texte de remplissage, à remplacer.",
    "Texto de relleno, sustituir.", "Aquí irá la descripción.", "Aquí va el texto.", "pendiente de redactar", "Descripción pendiente", "Texto provisional, reemplazar.",
    "Текст-заполнитель, заменить.", "Здесь будет описание.", "Здесь будет текст.", "описание позже", "текст позже", "Заглушка, заменить перед публикацией.",
    "此处填写说明。", "这里将显示说明。", "占位文字，请替换。", "说明待补充", "内容待定", "请在此输入文字。", "示例文本，仅供排版。",
    "ここに説明が入ります。", "説明は後日", "ダミーテキスト、差し替えてください。", "仮の文章です。", "ここに文章を入力してください。", "準備中", "サンプルテキスト、配置確認用。",
)
ERRORS = (
    "404 Not Found", "Error 404", "404 - page not found", "404 - the page you asked for is not here", "Page not found", "Error 404: the page does not exist.", "The page you asked for could not be found.",
    "The file may have been moved or deleted.", "This link has been removed or never existed.", "This link has expired.", "The requested album could not be opened.",
    "502 bad gateway", "503 Service Unavailable", "504 Gateway Timeout", "HTTP 500 internal error", "Internal Server Error", "500 Internal Server Error", "upstream timed out", "Error 503: the gallery server is busy, try again later",
    "Access denied. You are not allowed to view this album.", "403 Forbidden", "You do not have permission to see this page.", "Your session has expired. Sign in again to see this page.", "Please sign in to continue.",
    "Oops! Something went wrong on our side.", "Something went wrong. Please try again.", "An unexpected error occurred.", "Sorry, we could not load this page.", "Too many requests. Slow down and reload in 30 seconds.", "your quota is used up. Try again in a few minutes.",
    "The preview could not be generated (code 17).", "The thumbnail service is down for maintenance.", "Down for maintenance. Come back soon.", "Database connection failed while loading item 3", "Unhandled exception in viewer: NullImage at line 12",
    "the server returned an empty reply.", "the item was not found.", "the link is broken or out of date.", "this preview is unavailable.", "we can't reach the picture server.", "We cannot reach the store right now.", "Our team has been told.", "Check the address and retry.", "If the problem stays, write to the help desk.", "Sorry, the server is busy.",
    "Error. the request timed out.", "[!] the request timed out.", "Warning: the connection was lost.", "    at viewer.render(12)", "Traceback (most recent call last):", "request id 12-ab34", "Ref 12ab34cd", "Ask the owner for access.", "Reload", "Back to the start page", "Contact the site owner if this keeps happening.", "We are working on it.",
    "Fehler 404: Die Seite wurde nicht gefunden", "Seite nicht gefunden.", "Der Server ist gerade überlastet (503).", "Die Vorschau konnte nicht geladen werden, Code 17.", "Zugriff verweigert. Bitte melden Sie sich an.", "Bitte später erneut versuchen.", "Zur Startseite", "Ein Fehler ist aufgetreten.", "Interner Serverfehler",
    "Erreur 404 : page introuvable", "Page introuvable.", "Le serveur ne répond pas, code 503.", "Accès refusé. Connectez-vous.", "L'aperçu n'a pas pu être chargé, code 17.", "Réessayez plus tard.", "Retour à l'accueil", "Une erreur est survenue.", "Erreur interne du serveur",
    "Error 404: no existe la página", "Página no encontrada.", "El servidor no responde, código 503.", "Acceso denegado. Inicie sesión.", "No se pudo cargar la vista previa, código 17.", "Inténtelo más tarde.", "Volver al inicio", "Se ha producido un error.", "Error interno del servidor",
    "Ошибка 404: страница не найдена", "Страница не найдена.", "Сервер временно недоступен, код 503.", "Доступ запрещён. Войдите в систему.", "Не удалось загрузить предпросмотр, код 17.", "Попробуйте позже.", "На главную", "Произошла ошибка.", "Внутренняя ошибка сервера",
    "错误404：找不到页面", "找不到该页面。", "服务器暂时不可用，代码503。", "拒绝访问，请登录。", "无法加载预览，代码17。", "请稍后再试。", "返回首页", "发生错误。",
    "エラー404：ページが見つかりません", "ページが見つかりません。", "サーバーが応答しません、コード503。", "アクセスが拒否されました。ログインしてください。", "プレビューを読み込めませんでした、コード17。", "しばらくしてからもう一度お試しください。", "トップへ戻る", "エラーが発生しました。",
)
SCRIPTS = (
    "Please enable JavaScript to see this gallery.", "JavaScript is off. Switch it on to go on.", "JavaScript is required to view this page.", "JavaScript seems to be disabled; the album won't load without it.", "You need to enable JavaScript to run this app.",
    "This viewer needs scripts. Turn them on in your browser and reload.", "You have scripts switched off, so the slideshow cannot start.", "Your browser blocks scripts required by this page.", "No script support was found in your browser.",
    "Allow scripts for this address, then reload.", "We noticed that scripts are not allowed here. Without it you only see this note.", "Scripting is off. Change the setting or use another browser.", "This album is built in the browser. Switch it on to go on.", "Loading…", "Enable cookies and JavaScript, then reload.",
    "Bitte aktivieren Sie JavaScript, um die Galerie zu sehen.", "Diese Ansicht benötigt Skripte.", "Ihr Browser blockiert Skripte, die diese Seite braucht.", "JavaScript ist ausgeschaltet.",
    "Activez JavaScript pour voir la galerie.", "Cette page a besoin de scripts.", "Votre navigateur bloque les scripts.", "JavaScript est désactivé.",
    "Active JavaScript para ver la galería.", "Esta página necesita scripts.", "Su navegador bloquea los scripts.", "JavaScript está desactivado.",
    "Включите JavaScript, чтобы открыть галерею.", "Для просмотра нужны скрипты, разрешите их в браузере.", "В вашем браузере отключены скрипты.",
    "请启用JavaScript以查看图库。", "此页面需要脚本。", "您的浏览器禁用了脚本。", "ギャラリーを見るにはJavaScriptを有効にしてください。", "このページにはスクリプトが必要です。", "ブラウザーでスクリプトが無効になっています。",
)
#: Texts that report, quote or discuss residue, document a pattern or log an event.
MENTIONS = (
    "When I open the summer album it says \"404\" for a second and then the cover appears.", "The poster is called Page Not Found and hangs beside the window.", "JavaScript was off on the kiosk, we turned it on and now the picture shows up fine.",
    "She kept asking whether lorem ipsum would do for the poster; we wrote a real caption instead.", "In the template editor type {{title}} where the album name should go; we tested it with 12 albums.", "Set EXPORT_DIR to ${HOME}/albums and run the sorter again.",
    "The rename pattern {date}_{title}_{n} gave us Garden_12, which is what we wanted.", "Line 12 of the log mentions 'connection refused', yet all files were stored.", "TODO list of the club: rescan 12 slides, call the lab, label the boats.", "The reply was: [1] see the index, [2] look at the window, [3] compare <12> with the print.",
    "The sign reads ACCESS DENIED, behind it the ferry deck.", "The error page was printed and framed as a joke.", "Our report lists every error 500 of the last week.",
    "Beim Öffnen kam kurz \"Fehler 404\", danach war das Bild da.", "Das Muster {datum}_{titel} ergab Garten_12, genau richtig.", "Auf dem Schild steht ZUGRIFF VERWEIGERT, dahinter die Fähre.", "Der Platzhalter {{titel}} wird im Editor durch den Namen ersetzt.",
    "À l'ouverture, « erreur 404 » un instant, puis l'image.", "Le modèle {date}_{titre} a donné Jardin_12, comme prévu.", "Sur le panneau on lit ACCÈS REFUSÉ, derrière il y a le bac.",
    "Al abrir salió \"error 404\" un instante y luego apareció la foto.", "El patrón {fecha}_{título} dio Jardín_12, justo lo que queríamos.", "En el cartel pone ACCESO DENEGADO, detrás está el puente.",
    "При открытии мелькнуло «ошибка 404», затем появилась картинка.", "Шаблон {дата}_{имя} дал Сад_12, как и хотели.", "На табличке написано «доступ запрещён», за ней мост.",
    "打开时闪过“错误404”，随后图片就出现了。", "命名规则{日期}_{标题}得到花园_12，正合我意。", "牌子上写着“拒绝访问”，后面是渡船。", "開くと一瞬「エラー404」と出たが、そのあと写真が現れた。", "{日付}_{題名}という命名規則で庭_12になった、狙いどおり。", "看板には「立入禁止」とあり、その奥に渡し船が見える。",
    "12:01:44 stored IMG_12.jpg sim=0.81", "12:01:44 WARN no vector IMG_12.jpg", "11:20:02 ERROR could not read IMG_12.jpg, skipped", "00:00:12,100 --> 00:00:14,200",
)


def slot_texts() -> list[str]:
    """Every mark with every name, in frames that vary with both."""
    made = []
    for k, (mark, name) in enumerate(product(SLOT_MARKS, SLOT_NAMES)):
        frame = SLOT_FRAMES[k % len(SLOT_FRAMES)]
        made.append(frame % ((mark % name,) * frame.count("%s")))
    return made
