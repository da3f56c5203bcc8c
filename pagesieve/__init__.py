"""pagesieve: web-content extraction and assessment over tables and streams of stored pages."""
